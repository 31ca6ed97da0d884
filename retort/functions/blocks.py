"""Rows packed into blocks, one row a block, and pairs of blocks, one pair a task: all pairs of rows without sending a row through the driver.

Each block is written once to the shared folder and read by the tasks that need it, so the shuffle grows with the rows and only the comparisons with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.shared import checkpoint

#: What the packed rows of a block take at most.
BLOCK_BYTES = 8 << 20
#: Fewer rows are no block of their own.
LEAST_ROWS = 256


def tasks_wanted(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def block_count(rows: int, row_bytes: int, wanted: int) -> int:
    """As many as wanted, while blocks have LEAST_ROWS; more where blocks would be over BLOCK_BYTES."""
    return max(1, -(-rows * row_bytes // BLOCK_BYTES), min(wanted, rows // LEAST_ROWS))


def packed(rows: DataFrame, n: int, pack: Callable[[pa.Table], list[pa.Array]], schema: str) -> DataFrame:
    """rows dealt evenly into n partitions, each packed into one row of block and what pack gives by the schema."""
    names = ["block", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([t.column("block")[0].as_py()], pa.int32()), *pack(t)], names)

    d = rows.repartition(n).select(F.spark_partition_id().alias("block"), "*")
    return checkpoint(d.mapInArrow(run, f"block int, {schema}"))


def met(left: DataFrame, right: DataFrame, on: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Every block of left with every block of right (whose numbers are on), one pair a task: columns l_... and r_..."""
    l, r = left.select([F.col(c).alias(f"l_{c}") for c in left.columns]), right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.hint("shuffle_replicate_nl")
    return l.crossJoin(r) if on is None else l.join(r, on(F.col("l_block"), F.col("r_block")))


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1)
