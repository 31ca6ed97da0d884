"""Groups of rows in one Arrow pass, for tasks that are many and small: no start-up for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys side by side in one partition."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def sorted_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of one group after another; they come sorted by integer keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(cuts, cuts[1:]):
            held.append(b.slice(s, e - s))
            if e < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows, sorted by integer keys, in tables of many groups each; no group is cut."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        ids = np.stack([t.column(k).to_numpy() for k in keys])
        cut = int(np.flatnonzero((ids != ids[:, -1:]).any(axis=0)).max(initial=-1)) + 1
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None:
        yield rest
