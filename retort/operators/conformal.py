"""Conformal prediction: nonconformity scores, p-values, prediction sets and intervals, cross-conformal merging, antitonic calibration.

p-values are unsmoothed: (calibration scores >= s, plus one) / (calibration rows + 1). They come from ranks in one sort of calibration and
test scores together, split into ranges, never from a join of all pairs.
"""

from __future__ import annotations

import math
import warnings
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retort.functions.shared import checkpoint
from retort.operators.numbering import quantiles, ranked


def check_confidence(c: float) -> float:
    if not 0 < c <= 1:
        raise ValueError("confidence must be in (0, 1]")
    if c < 0.5:
        warnings.warn("confidence below 0.5", stacklevel=2)
    return c


def _others(p: Column, k: int) -> Column:
    return F.array_max(F.filter(p, lambda _, i: i != k))


#: score of class k from the array of probabilities (svm_margin: of a one-element decision value).
NONCONFORMITY = {
    "hinge": lambda p, k: 1 - F.get(p, F.lit(k)),
    "margin": lambda p, k: _others(p, k) - F.get(p, F.lit(k)),
    "log": lambda p, k: -F.log(F.greatest(F.get(p, F.lit(k)), F.lit(1e-10))),
    "svm_margin": lambda p, k: 1 + F.get(p, F.lit(0)) * (1 if k == 0 else -1),
}


def nonconformity(name: str):
    if name not in NONCONFORMITY:
        raise ValueError(f"unknown nonconformity {name!r}; known: {sorted(NONCONFORMITY)}")
    return NONCONFORMITY[name]


def class_scores(df: DataFrame, name: str, n_classes: int, proba: str = "proba") -> DataFrame:
    """Adds ``scores``: the nonconformity of every class."""
    f = nonconformity(name)
    return df.withColumn("scores", F.array(*[f(F.col(proba), k).cast("double") for k in range(n_classes)]))


def p_values(cal: DataFrame, test: DataFrame, mondrian: bool = False) -> DataFrame:
    """cal: label, score (of the true class). test: row_id, label (a class asked for), score -> row_id, label, p.

    mondrian: each class has its own calibration rows. The rank of a score among the calibration rows comes from range partitions: counts
    before a partition are added up on the driver (one number for each), the rest is a running count inside the partition.
    """
    group = F.col("label") if mondrian else F.lit(0)
    u = cal.select(group.alias("g"), F.col("score").alias("s"), F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("int").alias("label"), F.lit(1).alias("c"))
    u = u.union(test.select(group.alias("g"), F.col("score"), F.col("row_id").cast("long"), F.col("label").cast("int"), F.lit(0)))
    # written before it is counted: range bounds come from a sample, and would not be the same the second time
    u = checkpoint(u.repartitionByRange("g", F.desc("s")).withColumn("part", F.spark_partition_id()))
    # equal scores meet in one partition; among them all calibration rows count
    w = Window.partitionBy("part", "g").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counts: dict = {}
    for r in sorted(u.groupBy("g", "part").agg(F.sum("c").alias("n")).collect(), key=lambda r: r.part):
        counts.setdefault(r.g, []).append((r.part, r.n))
    before, total = [], []
    for g, parts in counts.items():
        at = 0
        for part, n in parts:
            before.append((g, part, at))
            at += n
        total.append((g, at))
    spark = u.sparkSession
    if not before:
        return test.select("row_id", "label", F.lit(None).cast("double").alias("p"))
    kind = u.schema["g"].dataType.simpleString()
    b = spark.createDataFrame([(*x, dict(total)[x[0]]) for x in before], f"g {kind}, part int, before long, total long")
    ranked = u.withColumn("upto", F.sum("c").over(w)).where("c = 0").join(F.broadcast(b), ["g", "part"])
    return ranked.select("row_id", "label", ((F.col("upto") + F.col("before") + 1) / (F.col("total") + 1)).alias("p"))


def prediction_sets(p: DataFrame, confidence: float) -> DataFrame:
    """row_id, label, p -> row_id, labels (ascending) whose p-value reaches 1 - confidence."""
    check_confidence(confidence)
    keep = F.when(F.col("p") >= 1 - confidence, F.col("label"))
    return p.groupBy("row_id").agg(F.sort_array(F.collect_list(keep)).alias("labels"))


def cross_p_values(p: DataFrame) -> DataFrame:
    """row_id, label, fold, p -> the exact median over folds."""
    return p.groupBy("row_id", "label").agg(F.percentile("p", F.lit(0.5)).alias("p"))


def evaluate_sets(sets: DataFrame, truth: DataFrame) -> DataFrame:
    """error, avg_c, one_c, empty of prediction sets against row_id, label."""
    d = sets.join(truth.select("row_id", F.col("label").alias("y")), "row_id")
    return d.agg(F.avg((~F.array_contains("labels", F.col("y"))).cast("int")).alias("error"), F.avg(F.size("labels")).alias("avg_c"),
                 F.avg((F.size("labels") == 1).cast("int")).alias("one_c"), F.avg((F.size("labels") == 0).cast("int")).alias("empty"))


def residual_quantile(n: int, confidence: float) -> int:
    """The rank (from the greatest, from 1) of the calibration residual that bounds intervals; 0 where none does."""
    return math.floor((1 - check_confidence(confidence)) * (n + 1) + 1e-12)


def intervals(cal: DataFrame, test: DataFrame, confidence: float = 0.9, bins: bool = False) -> DataFrame:
    """cal: y, pred[, bin, sigma]. test: row_id, pred[, bin, sigma] -> row_id, lo, hi; unbounded where calibration rows are too few.

    bins: a residual quantile for each bin (mondrian). sigma: a difficulty by which residuals are divided and intervals widened.
    """
    key = F.col("bin") if bins else F.lit(0)
    sigma = F.col("sigma") if "sigma" in cal.columns else F.lit(1.0)
    c = cal.select(key.alias("bin"), (F.abs(F.col("y") - F.col("pred")) / sigma).alias("r"))
    rank = F.floor((1 - check_confidence(confidence)) * (F.col("n") + 1) + 1e-12)
    q = ranked(c, "bin", [-F.col("r")]).where(F.col("rank") == rank).select("bin", F.col("r").alias("q"))  # one row a bin
    t = test.select("row_id", "pred", key.alias("bin"), (F.col("sigma") if "sigma" in test.columns else F.lit(1.0)).alias("sigma"))
    t = t.join(q, "bin", "left").withColumn("q", F.coalesce("q", F.lit(float("inf"))) * F.col("sigma"))
    return t.select("row_id", (F.col("pred") - F.col("q")).alias("lo"), (F.col("pred") + F.col("q")).alias("hi"))


def cross_intervals(parts: DataFrame) -> DataFrame:
    """row_id, fold, lo, hi -> the mean bounds."""
    return parts.groupBy("row_id").agg(F.avg("lo").alias("lo"), F.avg("hi").alias("hi"))


def evaluate_intervals(iv: DataFrame, truth: DataFrame) -> DataFrame:
    d = iv.join(truth, "row_id").select(((F.col("y") < F.col("lo")) | (F.col("y") > F.col("hi"))).cast("int").alias("e"), (F.col("hi") - F.col("lo")).alias("w"))
    median = quantiles(d, "w", [0.5])
    return d.agg(F.avg("e").alias("error"), F.avg("w").alias("eff_mean"), F.lit(median[0] if median else None).cast("double").alias("eff_med"))


def pool_adjacent(points: list[tuple[float, float, float]], increasing: bool = True) -> list[tuple[float, float]]:
    """Isotonic regression of (x, y, weight): (x, fitted y) at the distinct x, ascending."""
    merged: dict[float, list[float]] = {}
    for x, y, w in points:
        s = merged.setdefault(x, [0.0, 0.0])
        s[0], s[1] = s[0] + y * w, s[1] + w
    sign = 1 if increasing else -1
    blocks: list[list] = []
    for x in sorted(merged):
        y, w = merged[x]
        blocks.append([sign * y / w, w, [x]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
    return [(x, sign * v) for v, _, xs in blocks for x in xs]


def interpolate(curve: list[tuple[float, float]], x: float) -> float:
    """Linear between the points, constant beyond them."""
    xs = [p for p, _ in curve]
    i = bisect_left(xs, x)
    if i == 0:
        return curve[0][1]
    if i == len(xs):
        return curve[-1][1]
    (a, fa), (b, fb) = curve[i - 1], curve[i]
    return fa + (fb - fa) * (x - a) / (b - a)


def fit_antitonic(p_values: list[list[float]], epsilon: float = 1e-10) -> list[list[tuple[float, float]]]:
    """For each class the decreasing regression of 1 / (p + epsilon) on p; fitted on a bounded calibration set."""
    n = len(p_values[0])
    return [pool_adjacent([(r[k], 1 / (r[k] + epsilon), 1.0) for r in p_values], increasing=False) for k in range(n)]


def apply_antitonic(curves: list[list[tuple[float, float]]], p: list[float], epsilon: float = 1e-10) -> list[float]:
    """Probabilities in proportion to g(1) / (g(p) + epsilon), adding up to one."""
    raw = [interpolate(c, 1.0) / (interpolate(c, x) + epsilon) for c, x in zip(curves, p)]
    total = sum(raw)
    return [r / total for r in raw] if total > 0 else [1 / len(raw)] * len(raw)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with a made-up probability from the id: row_id, y, proba, cal."""
    h = (F.col("doc_id") * 7919 % 1000) / 1000.0
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("y"), F.array(1 - h, h).alias("proba"), (F.col("doc_id") % 2 == 0).alias("cal"))


def _p(spark: SparkSession, sf_dir: str, mondrian: bool) -> DataFrame:
    s = class_scores(_scored(spark, sf_dir), "hinge", 2)
    cal = s.where("cal").select(F.col("y").alias("label"), F.round(F.get("scores", F.col("y")), 6).alias("score"))
    test = s.where("NOT cal").select("row_id", F.posexplode("scores").alias("label", "score")).withColumn("score", F.round("score", 6))
    return p_values(cal, test, mondrian)


def _q_p(mondrian: bool):
    return lambda spark, sf_dir: _p(spark, sf_dir, mondrian).select("row_id", F.col("label").cast("long").alias("label"), F.round("p", 6).alias("p"))


def q_sets(spark, sf_dir):
    return prediction_sets(_p(spark, sf_dir, False), 0.8).select("row_id", F.concat_ws(",", F.transform("labels", lambda x: x.cast("string"))).alias("labels"))


def q_scores(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("row_id", *[F.round(nonconformity(n)(F.col("proba"), 1), 6).alias(n) for n in ("hinge", "margin", "log", "svm_margin")])


def _orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pred = F.lit(150000.0) + (F.col("o_custkey") % 100) * 500
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"), pred.alias("pred"), (F.col("o_custkey") % 4).alias("bin"), (F.col("o_orderkey") % 3 == 0).alias("cal"))


def _q_int(bins: bool):
    def q(spark, sf_dir):
        o = _orders(spark, sf_dir)
        return intervals(o.where("cal"), o.where("NOT cal"), 0.9, bins).select("row_id", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))

    return q


def q_cross(spark, sf_dir):
    """The median of the p-values of five folds of the calibration rows."""
    s = class_scores(_scored(spark, sf_dir), "hinge", 2)
    test = s.where("NOT cal").select("row_id", F.posexplode("scores").alias("label", "score")).withColumn("score", F.round("score", 6))
    out = None
    for k in range(5):
        cal = s.where(F.col("cal") & (F.floor(F.col("row_id") / 2) % 5 == k)).select(F.col("y").alias("label"), F.round(F.get("scores", F.col("y")), 6).alias("score"))
        p = p_values(cal, test).withColumn("fold", F.lit(k))
        out = p if out is None else out.union(p)
    return cross_p_values(out).select("row_id", F.col("label").cast("long").alias("label"), F.round("p", 6).alias("p"))


def q_cross_intervals(spark, sf_dir):
    """The mean bounds of the intervals of three folds of the calibration rows."""
    o, out = _orders(spark, sf_dir), None
    for k in range(3):
        iv = intervals(o.where(F.col("cal") & (F.col("row_id") % 9 == 3 * k)), o.where("NOT cal"), 0.9)
        out = iv if out is None else out.union(iv)
    return cross_intervals(out).select("row_id", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


QUERIES = {"conformal_p": _q_p(False), "conformal_p_mondrian": _q_p(True), "conformal_sets": q_sets, "nonconformity": q_scores, "conformal_intervals": _q_int(False), "conformal_intervals_mondrian": _q_int(True), "cross_conformal_p": q_cross, "cross_intervals": q_cross_intervals}
_S = """WITH s AS (SELECT doc_id AS row_id, quality AS y, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS h, doc_id % 2 = 0 AS cal FROM labels),
c AS (SELECT y AS label, round(CASE WHEN y = 1 THEN 1 - h ELSE 1 - (1 - h) END, 6) AS score FROM s WHERE cal),
t AS (SELECT row_id, 0 AS label, round(1 - (1 - h), 6) AS score FROM s WHERE NOT cal UNION ALL SELECT row_id, 1, round(1 - h, 6) FROM s WHERE NOT cal),
p AS (SELECT row_id, label, ((SELECT count(*) FROM c WHERE c.score >= t.score {0}) + 1) / ((SELECT count(*) FROM c WHERE true {0}) + 1) AS p FROM t)
"""
_M = "AND c.label = t.label"
_I = """WITH o AS (SELECT o_orderkey AS row_id, o_totalprice AS y, 150000.0::DOUBLE + (o_custkey % 100) * 500 AS pred, {0} AS bin, o_orderkey % 3 = 0 AS cal FROM orders),
r AS (SELECT bin, abs(y - pred) AS r, row_number() OVER (PARTITION BY bin ORDER BY abs(y - pred) DESC) AS i, count(*) OVER (PARTITION BY bin) AS n FROM o WHERE cal),
q AS (SELECT bin, r AS q FROM r WHERE i = floor((1 - 0.9::DOUBLE) * (n + 1) + 1e-12))
SELECT row_id, round(pred - q, 4) AS lo, round(pred + q, 4) AS hi FROM o JOIN q USING (bin) WHERE NOT cal"""
ORACLE_SQL = {
    "conformal_p": _S.format("") + "SELECT row_id, CAST(label AS BIGINT) AS label, round(p, 6) AS p FROM p",
    "conformal_p_mondrian": _S.format(_M) + "SELECT row_id, CAST(label AS BIGINT) AS label, round(p, 6) AS p FROM p",
    "conformal_sets": _S.format("") + "SELECT row_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (p >= 1 - 0.8::DOUBLE), '') AS labels FROM p GROUP BY row_id",
    "nonconformity": "WITH s AS (SELECT doc_id AS row_id, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS h FROM labels) SELECT row_id, round(1 - h, 6) AS hinge, round(1 - h - h, 6) AS margin, round(-ln(greatest(h, 1e-10)), 6) AS log, round(1 - (1 - h), 6) AS svm_margin FROM s",
    "conformal_intervals": _I.format("0"), "conformal_intervals_mondrian": _I.format("o_custkey % 4"),
    "cross_conformal_p": _S.format("").partition("p AS (")[0].replace("c AS (SELECT y AS label", "c AS (SELECT row_id // 2 % 5 AS fold, y AS label") + "p AS (SELECT row_id, label, fold, ((SELECT count(*) FROM c WHERE c.fold = f.fold AND c.score >= t.score) + 1) / ((SELECT count(*) FROM c WHERE c.fold = f.fold) + 1) AS p FROM t, range(5) f(fold)) "
    "SELECT row_id, CAST(label AS BIGINT) AS label, round(quantile_cont(p, 0.5), 6) AS p FROM p GROUP BY row_id, label",
    "cross_intervals": """WITH o AS (SELECT o_orderkey AS row_id, o_totalprice AS y, 150000.0::DOUBLE + (o_custkey % 100) * 500 AS pred FROM orders),
r AS (SELECT row_id % 9 AS bin, abs(y - pred) AS r, row_number() OVER (PARTITION BY row_id % 9 ORDER BY abs(y - pred) DESC) AS i, count(*) OVER (PARTITION BY row_id % 9) AS n FROM o WHERE row_id % 3 = 0),
q AS (SELECT bin, r AS q FROM r WHERE i = floor((1 - 0.9::DOUBLE) * (n + 1) + 1e-12)) SELECT row_id, round(avg(pred - q), 4) AS lo, round(avg(pred + q), 4) AS hi FROM o, q WHERE row_id % 3 <> 0 GROUP BY row_id""",
}
