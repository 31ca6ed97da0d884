"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.shared import checkpoint, shared_folder

__all__ = ["WS", "buckets_for", "checkpoint", "fresh", "input_bytes", "let", "map_rows", "shared_folder", "table"]

#: White space of every word contract: blank and the controls 9 to 13.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly expression once, so that the optimiser cannot inline it into a lambda that runs per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(docs: DataFrame, run: Callable) -> DataFrame:
    """docs.mapInArrow(run) to the same columns, whatever their names (mapInArrow itself takes none with a dot)."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), docs.schema)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate (file sizes for a scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_per_bucket: int, least: int = 8, most: int = 1 << 22) -> int:
    return max(least, min(most, math.ceil(input_bytes(df) / bytes_per_bucket)))
