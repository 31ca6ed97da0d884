"""Consecutive numbers in sorted order without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retort.functions.shared import checkpoint


def number_in_order(values: DataFrame, col: str, name: str) -> DataFrame:
    """values: rows with a distinct col -> col, name: 0, 1, 2... in its order.

    Range partitions are sorted on their own; one count a partition comes to the driver. The partitions are written before they are counted: their
    bounds come from a sample, and would not be the same the second time.
    """
    d = values.select(col).repartitionByRange(col).sortWithinPartitions(col).select(col, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    d = checkpoint(d)
    offset, at = [], 0
    for r in sorted(d.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        offset += [F.lit(r["_p"]), F.lit(at)]
        at += r["n"]
    if not offset:
        return d.select(col, F.lit(0).cast("long").alias(name))
    k = F.row_number().over(Window.partitionBy("_p").orderBy("_m"))
    return d.select(col, (F.element_at(F.create_map(*offset), F.col("_p")) + k - 1).cast("long").alias(name))


def ranked(rows: DataFrame, group: str, order: list[Column], add: str | None = None) -> DataFrame:
    """rows with rank (from 1 in their group, by order), n (rows of the group) and, for a column to add, upto and total (its running and whole sum).

    No group is sorted in one task: range partitions are ranked on their own, and what stands before a partition comes from one row for each
    group and partition. Equal rows by order have any order; let it end with a key.
    """
    names = [f"_o{i}" for i in range(len(order))]
    d = rows.withColumns(dict(zip(names, order)))
    d = checkpoint(d.repartitionByRange(group, *names).withColumn("_p", F.spark_partition_id()))
    value = F.col(add) if add else F.lit(0)
    parts = d.groupBy(group, "_p").agg(F.count("*").alias("_c"), F.sum(value).alias("_s"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    parts = parts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(before), none).alias("_c0"), F.coalesce(F.sum("_s").over(before), none).alias("_s0"),
                         F.sum("_c").over(whole).alias("n"), F.sum("_s").over(whole).alias("total"))
    here = Window.partitionBy("_p", group).orderBy(*names)
    d = d.withColumn("_r", F.row_number().over(here)).withColumn("_u", F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    out = d.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    sums = [(F.col("_u") + F.col("_s0")).alias("upto"), "total"] if add else []
    return out.select(*[c for c in rows.columns], (F.col("_r") + F.col("_c0")).alias("rank"), "n", *sums)


def quantiles(rows: DataFrame, col: str, shares: list[float]) -> list[float]:
    """Exact quantiles, linear between neighbours, from ranks: only the rows that bound one come to the driver."""
    d = rows.where(F.col(col).isNotNull()).select(F.lit(0).alias("g"), F.col(col).cast("double").alias("v"))
    r = ranked(d, "g", [F.col("v")])
    n = d.count()
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    wanted = sorted({int(x) + k for x in at for k in (1, 2) if int(x) + k <= n})
    found = {x["rank"]: x.v for x in r.where(F.col("rank").isin(wanted)).select("rank", "v").collect()}
    return [found[int(x) + 1] + (found.get(int(x) + 2, 0.0) - found[int(x) + 1]) * (x - int(x)) if x > int(x) else found[int(x) + 1] for x in at]
