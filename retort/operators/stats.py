"""Fitted statistics: population scaling, variance filter, class weights, ensemble aggregates, scores that ignore a value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, in one pass; 1 where a column does not vary."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def scale(df: DataFrame, state: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in state.items()})


def varying_columns(df: DataFrame, cols: list[str], threshold: float = 0.0) -> list[str]:
    """Those of population variance above the threshold."""
    row = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"v{i}"] is not None and row[f"v{i}"] > threshold]


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """label, weight: rows / (classes * rows of the class)."""
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # over the classes, not the rows
    return g.select(label, (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def ensemble_mean(preds: DataFrame) -> DataFrame:
    """row_id, y over members -> row_id, mean, std (population)."""
    return preds.groupBy("row_id").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))


def hard_vote(preds: DataFrame) -> DataFrame:
    """The most frequent class; the least of equals."""
    return preds.groupBy("row_id").agg(F.mode("y", True).alias("y"))


def soft_vote(preds: DataFrame, classes: list) -> DataFrame:
    """row_id, proba (array) over members -> the class of the greatest mean probability; the first of equals."""
    n = len(classes)
    mean = F.array(*[F.avg(F.get("proba", F.lit(i))) for i in range(n)])
    p = preds.groupBy("row_id").agg(mean.alias("p"))
    return p.select("row_id", F.get(F.array(*map(F.lit, classes)), F.array_position("p", F.array_max("p")).cast("int") - 1).alias("y"))


def ignoring(df: DataFrame, y_true: str, y_pred: str, ignore: float | None = None) -> DataFrame:
    """Without rows whose truth or prediction is the value to ignore; null and NaN are one when that is null."""
    ok = (lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))) if ignore is None or math.isnan(ignore) else (lambda c: ~F.col(c).eqNullSafe(F.lit(ignore)))
    return df.where(ok(y_true) & ok(y_pred))


def balanced_accuracy(df: DataFrame, y_true: str, y_pred: str, weight: Column | None = None, ignore: float | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    d = ignoring(df, y_true, y_pred, ignore).withColumn("_w", w)
    recall = d.groupBy(y_true).agg((F.sum(F.when(F.col(y_true) == F.col(y_pred), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("r"))
    return recall.agg(F.avg("r").alias("score"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *_COLS)
    d = scale(li, fit_scaler(li, _COLS))
    return d.select("l_orderkey", "l_linenumber", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in _COLS])


def q_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("fixed", F.lit(3.0))
    return spark.createDataFrame([(c,) for c in varying_columns(li, [*_COLS, "fixed"])], "name string")


def q_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality").select("quality", F.round("weight", 6).alias("weight"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the predictions of several members for each order."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("y"), "l_discount")


def q_ensemble(spark, sf_dir):
    return ensemble_mean(_members(spark, sf_dir)).select("row_id", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def q_hard(spark, sf_dir):
    return hard_vote(_members(spark, sf_dir))


def q_soft(spark, sf_dir):
    m = _members(spark, sf_dir).withColumn("proba", F.array(F.round(F.col("y") * 2).cast("long"), F.lit(50).cast("long")))
    return soft_vote(m, ["a", "b"])


def q_scorer(spark, sf_dir):
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    d = lab.select(F.col("quality").alias("t"), F.when(F.col("doc_id") % 7 == 0, None).otherwise((F.col("doc_id") % 5 > 0).cast("int")).alias("p"))
    return balanced_accuracy(d, "t", "p").select(F.round("score", 6).alias("score"))


QUERIES = {"scaler": q_scaler, "variance_filter": q_variance, "balanced_weights": q_weights, "ensemble_mean_std": q_ensemble, "hard_vote": q_hard, "soft_vote": q_soft, "ignore_value_scorer": q_scorer}
ORACLE_SQL = {
    "scaler": "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _COLS) + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) + 0.0 AS {c}" for c in _COLS) + " FROM lineitem, s",
    "variance_filter": " UNION ALL ".join(f"SELECT '{c}' AS name FROM lineitem HAVING var_pop({c}) > 0" for c in _COLS),
    "balanced_weights": "SELECT quality, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality",
    "ensemble_mean_std": "SELECT l_orderkey AS row_id, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS std FROM lineitem GROUP BY 1",
    "hard_vote": "WITH c AS (SELECT l_orderkey AS row_id, l_quantity AS y, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT row_id, y FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, y) AS k FROM c) WHERE k = 1",
    "soft_vote": "SELECT l_orderkey AS row_id, CASE WHEN avg(CAST(round(l_quantity * 2) AS BIGINT)) >= 50 THEN 'a' ELSE 'b' END AS y FROM lineitem GROUP BY 1",
    "ignore_value_scorer": "WITH d AS (SELECT quality AS t, (doc_id % 5 > 0)::INT AS p FROM labels WHERE doc_id % 7 <> 0), r AS (SELECT t, avg((t = p)::INT) AS r FROM d GROUP BY t) SELECT round(avg(r), 6) AS score FROM r",
}
