"""Connected components by alternating large-star and small-star rounds.

No link, component or node list reaches the driver; each round joins on a node with the minimum of its neighbours, and
the edge table never outgrows the input. Rounds are logarithmic in the longest path. Lineage is cut by a reliable
checkpoint after each round, so a lost executor costs no more than the current one. Nodes are longs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions.shared import checkpoint


def _with_min(e: DataFrame) -> DataFrame:
    """e (u, v) with m, the least v of each u."""
    return e.join(e.groupBy(F.col("u").alias("g")).agg(F.min("v").alias("m")), F.col("u") == F.col("g")).select("u", "v", "m")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(u), find(v)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task_below: int = 0) -> DataFrame:
    """edges (a, b), any order, repeats and loops allowed -> node, component (its least node).

    Only nodes with an edge to another appear: a node alone is its own component. Each partition first contracts its own links to stars.
    Fewer links than one_task_below (counted) are joined by union-find in one executor task; any number more takes the rounds.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    stars = e.mapInArrow(_union_find, "node long, component long").where("node <> component")
    e, seen = checkpoint(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).distinct()), None
    if one_task_below and e.limit(one_task_below).count() < one_task_below:
        return e.coalesce(1).mapInArrow(_union_find, "node long, component long")
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        low = _with_min(large)
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
