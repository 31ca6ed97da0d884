"""Small helpers: cores, timing, equality of tables, counts of clusters."""

from __future__ import annotations

import logging
import os
import time
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def check_cores(n: int, available: int | None = None) -> int:
    """So many cores; a negative number counts from the end (-1: all). More than there are gives all, with a warning."""
    have = available or os.cpu_count() or 1
    if n == 0 or n < -have:
        raise ValueError("n must not be zero, nor below minus the number of cores")
    if n < 0:
        return have + 1 + n
    if n > have:
        warnings.warn(f"only {have} cores are there", stacklevel=2)
    return min(n, have)


@contextmanager
def elapsed_time(what: str, level: int = logging.INFO) -> Iterator[None]:
    """Logs how long the block took, also if it fails."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log.log(level, "%s took %.3f s", what, time.perf_counter() - began)


def are_equal(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, as often, in columns of the same names and types; in any order. Maps are compared as sorted entries."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        return False
    plain = lambda d: d.select(*[F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map") else F.col(c) for c, t in sorted(d.dtypes)])
    x, y = plain(a), plain(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def n_clusters(df: DataFrame, col: str) -> int:
    """Distinct clusters; null and NaN are none."""
    return df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(col).distinct().count()
