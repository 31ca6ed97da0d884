"""Train/test splitters. Each gives split_id, row_id, role ('train' or 'test'), pos (which draw, for repeated rows).

Seeded choices come from a hash of seed and key, so they depend neither on partitions nor on row order, and SQL can replay them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.timeutil import group_of, resolve_instant, thresholds_for_n_years
from retort.operators.numbering import number_in_order, quantiles, ranked


def seeded_hash(seed: int, *key: Column) -> Column:
    """In [0, 2**32): the first 32 bits of the MD5 of ``seed:key:key...``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _check(n: int, name: str = "n_splits") -> None:
    if n < 1:
        raise ValueError(f"{name} must be positive")


def group_addition(rows: DataFrame, n_skip: int = 1, max_splits: int | None = None) -> DataFrame:
    """rows: row_id, grp. Split i tests on one group and trains on all before it; the first n_skip groups are not tested."""
    if n_skip < 1:
        raise ValueError("n_skip must be positive")
    groups = rows.select("grp").where("grp IS NOT NULL").distinct()
    ranked_ = number_in_order(groups, "grp", "g").select("grp", (F.col("g") + 1).alias("g"))
    ranked_ = ranked_.withColumn("n", F.lit(ranked_.count()))
    first = F.lit(n_skip) if max_splits is None else F.greatest(F.lit(n_skip), F.col("n") - max_splits)
    tests = ranked_.where(F.col("g") > first).select((F.col("g") - first - 1).alias("split_id"), F.col("g").alias("test_g"))
    if tests.isEmpty():
        raise ValueError("no group is left to test on")
    r = rows.join(ranked_.select("grp", "g", first.alias("first"), "n"), "grp")  # Spark broadcasts the groups where they are few
    # a row is in the split of its own group and in all later ones
    out = r.where(F.greatest("g", F.col("first") + 1) <= F.col("n")).withColumn("test_g", F.explode(F.sequence(F.greatest("g", F.col("first") + 1), F.col("n"))))
    return out.withColumn("split_id", F.col("test_g") - F.col("first") - 1).select("split_id", "row_id", F.when(F.col("g") == F.col("test_g"), "test").otherwise("train").alias("role"), F.lit(0).cast("long").alias("pos"))


def time_threshold(rows: DataFrame, thresholds: list[datetime], n_skip: int = 1, max_splits: int | None = None) -> DataFrame:
    """rows: row_id, ts. Groups are the spans between thresholds; then as group_addition."""
    return group_addition(rows.select("row_id", group_of(F.col("ts"), thresholds).alias("grp")), n_skip, max_splits)


def time_threshold_from_final(rows: DataFrame, final: str | datetime = "today", n_years: int = 5, splits_per_year: int = 1, precision: str = "D", max_splits: int | None = None) -> DataFrame:
    return time_threshold(rows, thresholds_for_n_years(resolve_instant(final), n_years, splits_per_year, precision), 1, max_splits)


def stratified_folds(rows: DataFrame, n_splits: int = 5, seed: int | None = 42) -> DataFrame:
    """rows: row_id, stratum -> row_id, stratum, fold: each stratum dealt out evenly (seed None: in order of row_id)."""
    _check(n_splits)
    order = [F.col("row_id")] if seed is None else [seeded_hash(seed, F.col("row_id")), F.col("row_id")]
    r = ranked(rows.select("row_id", "stratum"), "stratum", order)
    return r.select("row_id", "stratum", ((F.col("rank") - 1) % n_splits).alias("fold"))


def folds_to_splits(folds: DataFrame, n_splits: int) -> DataFrame:
    ids = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    out = folds.select("row_id", "fold", ids.alias("split_id"))
    return out.select("split_id", "row_id", F.when(F.col("fold") == F.col("split_id"), "test").otherwise("train").alias("role"), F.lit(0).cast("long").alias("pos"))


def percentile_bins(rows: DataFrame, n_groups: int = 10) -> DataFrame:
    """rows: row_id, y -> row_id, stratum: bins between exact percentiles, closed on the right, the first one on both sides."""
    if rows.select("y").distinct().limit(n_groups).count() < n_groups:
        raise ValueError("n_groups is greater than the number of distinct targets")
    edges = quantiles(rows, "y", [i / n_groups for i in range(n_groups + 1)])
    if len(set(edges)) < len(edges):
        raise ValueError("bin edges are not unique")
    stratum = F.lit(0)
    for e in edges[1:-1]:
        stratum = stratum + (F.col("y") > e).cast("int")
    return rows.select("row_id", stratum.alias("stratum"))


def percentile_stratified_kfold(rows: DataFrame, n_splits: int = 5, n_groups: int = 10, seed: int | None = 42) -> DataFrame:
    return folds_to_splits(stratified_folds(percentile_bins(rows, n_groups), n_splits, seed), n_splits)


def _sizes(test_size: float | int | None, train_size: float | int | None) -> tuple[float | int, float | int | None]:
    """Shares in (0, 1) or counts; what is left out is the rest, and with neither a fifth is tested."""
    for size in (test_size, train_size):
        if isinstance(size, float) and not 0 < size < 1 or isinstance(size, int) and size < 1:
            raise ValueError("sizes must be shares in (0, 1) or positive counts")
    if isinstance(test_size, float) and isinstance(train_size, float) and test_size + train_size > 1:
        raise ValueError("the sizes are more than all")
    if test_size is None:
        test_size = 0.2 if train_size is None else (1.0 - train_size if isinstance(train_size, float) else -train_size)
    return test_size, train_size


def group_shuffle(rows: DataFrame, n_splits: int = 5, test_size: float | int | None = None, split_mode: str = "groups", seed: int = 42, train_size: float | int | None = None) -> DataFrame:
    """rows: row_id, grp. Whole groups go to one side; sizes are counted in groups, or in samples. Groups beyond train_size are on no side.

    groups: in hash order, the first ceil(test_size * groups) are tested and the next floor(train_size * groups) trained on. samples: groups
    are taken in hash order to the test side while they keep it within its target, the rest in that order to the train side likewise.
    Both take ranks and running sums over range partitions of the groups.
    """
    _check(n_splits)
    test, train = _sizes(test_size, train_size)
    if split_mode not in ("groups", "samples"):
        raise ValueError("split_mode must be 'groups' or 'samples'")
    g = rows.groupBy("grp").agg(F.count("*").alias("size")).select("grp", "size", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split_id"))
    r = ranked(g, "split_id", [seeded_hash(seed, F.col("split_id"), F.col("grp")), F.col("grp")], "size")
    whole = F.col("n") if split_mode == "groups" else F.col("total")
    share = lambda x, f: f(whole * x) if isinstance(x, float) else (whole + x if x < 0 else F.lit(x))
    if split_mode == "groups":
        tested = F.col("rank") <= share(test, F.ceil)
        trained = F.lit(True) if train is None else F.col("rank") <= share(test, F.ceil) + share(train, F.floor)
    else:
        tested = (F.col("upto") <= share(test, F.round)) | (F.col("rank") == 1)
        trained = F.lit(True) if train is None else F.col("upto") <= share(test, F.round) + share(train, F.round)
    side = r.select("split_id", "grp", F.when(tested, "test").when(trained, "train").alias("role")).where("role IS NOT NULL")
    return rows.join(side, "grp").select("split_id", "row_id", "role", F.lit(0).cast("long").alias("pos"))


def bootstrap(rows: DataFrame, n_splits: int, max_samples: int | float | None = None, seed: int = 42) -> DataFrame:
    """Draws with replacement (train, pos = draw number); the rows not drawn are tested."""
    _check(n_splits)
    n = rows.count()
    if isinstance(max_samples, float):
        if not 0 < max_samples <= 1:
            raise ValueError("a float max_samples must be in (0, 1]")
        draws = max(1, round(n * max_samples))
    else:
        draws = n if max_samples is None else min(max_samples, n)
    if draws < 1:
        raise ValueError("max_samples must be positive")
    spark = rows.sparkSession
    dense = number_in_order(rows, "row_id", "i")
    d = spark.range(draws).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split_id"))
    d = d.select("split_id", "pos", F.floor(seeded_hash(seed, F.col("split_id"), F.col("pos")) * n / F.lit(2**32)).cast("long").alias("i"))
    train = d.join(dense, "i").select("split_id", "row_id", F.lit("train").alias("role"), "pos")
    every = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split_id"))
    test = every.join(train.select("split_id", "row_id"), ["split_id", "row_id"], "left_anti").select("split_id", "row_id", F.lit("test").alias("role"), F.lit(0).cast("long").alias("pos"))
    return train.union(test)


def repetition(rows: DataFrame, n_splits: int) -> DataFrame:
    """Every split trains on all rows and tests on none."""
    _check(n_splits)
    return rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split_id"), "row_id", F.lit("train").alias("role"), F.lit(0).cast("long").alias("pos"))


def ordinal_codes(rows: DataFrame, col: str) -> DataFrame:
    """Codes of the distinct values in order, as doubles; null stays null. -> row_id, code."""
    d = rows.where(F.col(col).isNotNull()).select(col).distinct()
    d = number_in_order(d, col, "code").select(F.col(col).alias("v"), F.col("code").cast("double").alias("code"))
    return rows.join(d, F.col(col) == F.col("v"), "left").select("row_id", "code")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


THRESHOLDS = [datetime(1998, 1, 1), datetime(1997, 1, 1), datetime(2000, 6, 15)]


#: Rows whose distinct ids one task holds.
COUNTED_ROWS = 250_000


def _summary(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Counts of splits of rows. Ids compress so well that partitions sized by bytes would hold more of them than a task can, so their number follows the rows (a few splits a row)."""
    parts = -(-4 * rows.count() // COUNTED_ROWS)
    d = splits.select("split_id", "role", "row_id").repartition(max(parts, 1), "split_id", "role", "row_id")
    s = d.groupBy("split_id", "role").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_rows"), F.sum("row_id").alias("sum_id"))
    return s.select(F.col("split_id").cast("long").alias("split_id"), "role", "n", "n_rows", "sum_id")


def q_group_addition(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return _summary(_orders(spark, sf_dir), group_addition(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("grp")), 2))


def q_time_threshold(spark, sf_dir):
    return _summary(_orders(spark, sf_dir), time_threshold(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("ts")), THRESHOLDS))


def q_stratified(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"))
    return stratified_folds(percentile_bins(o, 10), 5).select("row_id", F.col("stratum").cast("long").alias("stratum"), F.col("fold").cast("long").alias("fold"))


def _q_shuffle(mode: str):
    def q(spark, sf_dir):
        return _summary(_orders(spark, sf_dir), group_shuffle(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("grp")), 3, 0.25, mode))

    return q


def q_shuffle_train(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("grp"))
    return _summary(_orders(spark, sf_dir), group_shuffle(o, 3, 0.25, "groups", train_size=0.5))


def q_percentile_splits(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"))
    return _summary(_orders(spark, sf_dir), percentile_stratified_kfold(o, 4, 5))


def q_max_splits(spark, sf_dir):
    return _summary(_orders(spark, sf_dir), group_addition(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("grp")), 1, 2))


def q_years(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("ts"))
    return _summary(_orders(spark, sf_dir), time_threshold_from_final(o, datetime(2000, 1, 1), 5, 2))


def q_bootstrap(spark, sf_dir):
    return _summary(_orders(spark, sf_dir), bootstrap(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_id")), 3))


def q_repetition(spark, sf_dir):
    return _summary(_orders(spark, sf_dir), repetition(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_id")), 4))


def q_ordinal(spark, sf_dir):
    return ordinal_codes(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("row_id"), "p_type"), "p_type")


QUERIES = {
    "group_addition_split": q_group_addition, "time_threshold_split": q_time_threshold, "percentile_stratified_kfold": q_stratified, "group_shuffle_groups": _q_shuffle("groups"),
    "group_shuffle_samples": _q_shuffle("samples"), "bootstrap_split": q_bootstrap, "repetition_split": q_repetition, "ordinal_codes": q_ordinal,
    "group_shuffle_train_size": q_shuffle_train, "percentile_stratified_splits": q_percentile_splits, "group_addition_max_splits": q_max_splits, "time_threshold_years": q_years,
}
_SUM = "SELECT CAST(split_id AS BIGINT) AS split_id, role, count(*) AS n, count(DISTINCT row_id) AS n_rows, CAST(sum(row_id) AS BIGINT) AS sum_id FROM s GROUP BY ALL"
_H = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
_SHUFFLE = """
WITH g AS (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT grp, n, i AS split_id, {h} AS h FROM g, range(3) t(i)),
r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY split_id) AS c, sum(n) OVER (PARTITION BY split_id) AS total
      FROM x WINDOW w AS (PARTITION BY split_id ORDER BY h, grp)),
s AS (SELECT split_id, o_orderkey AS row_id, CASE WHEN {test} THEN 'test' ELSE 'train' END AS role FROM r JOIN orders ON o_custkey = grp)
""".replace("{h}", _H.format("'42:' || i || ':' || grp"))
ORACLE_SQL = {
    "group_addition_split": "WITH g AS (SELECT o_orderkey AS row_id, dense_rank() OVER (ORDER BY o_orderpriority) AS g FROM orders), t AS (SELECT DISTINCT g AS tg FROM g WHERE g > 2), "
    "s AS (SELECT tg - 3 AS split_id, row_id, CASE WHEN g = tg THEN 'test' ELSE 'train' END AS role FROM g JOIN t ON g <= tg) " + _SUM,
    "time_threshold_split": "WITH b AS (SELECT o_orderkey AS row_id, (o_orderdate >= '1997-01-01')::INT + (o_orderdate >= '1998-01-01')::INT + (o_orderdate >= '2000-06-15')::INT AS b FROM orders), "
    "g AS (SELECT row_id, dense_rank() OVER (ORDER BY b) AS g FROM b), t AS (SELECT DISTINCT g AS tg FROM g WHERE g > 1), "
    "s AS (SELECT tg - 2 AS split_id, row_id, CASE WHEN g = tg THEN 'test' ELSE 'train' END AS role FROM g JOIN t ON g <= tg) " + _SUM,
    "percentile_stratified_kfold": "WITH e AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM orders), "
    "b AS (SELECT o_orderkey AS row_id, len(list_filter(e, lambda x: o_totalprice > x)) AS stratum FROM orders, e) "
    f"SELECT row_id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY {_H.format(chr(39) + '42:' + chr(39) + ' || row_id')}, row_id) - 1) % 5 AS fold FROM b",
    "group_shuffle_groups": _SHUFFLE.replace("{test}", "k <= ceil(c * 0.25)") + _SUM,
    "group_shuffle_samples": _SHUFFLE.replace("{test}", "upto <= round(total * 0.25) OR k = 1") + _SUM,
    "bootstrap_split": "WITH d AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), "
    f"p AS (SELECT split_id, CAST(floor({_H.format(chr(39) + '42:' + chr(39) + ' || split_id || ' + chr(39) + ':' + chr(39) + ' || pos')} * (SELECT count(*) FROM orders) / 4294967296) AS BIGINT) AS i FROM range(3) a(split_id), range((SELECT count(*) FROM orders)) b(pos)), "
    "t AS (SELECT split_id, row_id, 'train' AS role FROM p JOIN d USING (i)), s AS (SELECT * FROM t UNION ALL SELECT split_id, o_orderkey, 'test' FROM orders, range(3) a(split_id) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.split_id = a.split_id AND t.row_id = o_orderkey)) " + _SUM,
    "group_shuffle_train_size": _SHUFFLE.replace("CASE WHEN {test} THEN 'test' ELSE 'train' END AS role FROM r JOIN orders ON o_custkey = grp", "CASE WHEN k <= ceil(c * 0.25) THEN 'test' ELSE 'train' END AS role FROM r JOIN orders ON o_custkey = grp WHERE k <= ceil(c * 0.25) + floor(c * 0.5)") + _SUM,
    "percentile_stratified_splits": "WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders), b AS (SELECT o_orderkey AS row_id, len(list_filter(e, lambda x: o_totalprice > x)) AS stratum FROM orders, e), "
    f"f AS (SELECT row_id, (row_number() OVER (PARTITION BY stratum ORDER BY {_H.format(chr(39) + '42:' + chr(39) + ' || row_id')}, row_id) - 1) % 4 AS fold FROM b), "
    "s AS (SELECT i AS split_id, row_id, CASE WHEN fold = i THEN 'test' ELSE 'train' END AS role FROM f, range(4) t(i)) " + _SUM,
    "group_addition_max_splits": "WITH g AS (SELECT o_orderkey AS row_id, dense_rank() OVER (ORDER BY o_orderpriority) AS g FROM orders), m AS (SELECT max(g) AS m FROM g), "
    "s AS (SELECT tg - m + 1 AS split_id, row_id, CASE WHEN g = tg THEN 'test' ELSE 'train' END AS role FROM g, m, (SELECT DISTINCT g AS tg FROM g) WHERE g <= tg AND tg > m - 2) " + _SUM,
    "time_threshold_years": "WITH t AS (SELECT make_date(2000 - y, 1, 1) AS t FROM range(5) x(y) UNION ALL SELECT make_date(1999 - y, 1, 1) + CAST((make_date(2000 - y, 1, 1) - make_date(1999 - y, 1, 1)) // 2 AS INTEGER) FROM range(5) x(y)), "
    "b AS (SELECT o_orderkey AS row_id, (SELECT count(*) FROM t WHERE o_orderdate >= t) AS b FROM orders), g AS (SELECT row_id, dense_rank() OVER (ORDER BY b) AS g FROM b), t2 AS (SELECT DISTINCT g AS tg FROM g WHERE g > 1), "
    "s AS (SELECT tg - 2 AS split_id, row_id, CASE WHEN g = tg THEN 'test' ELSE 'train' END AS role FROM g JOIN t2 ON g <= tg) " + _SUM,
    "repetition_split": "WITH s AS (SELECT split_id, o_orderkey AS row_id, 'train' AS role FROM orders, range(4) a(split_id)) " + _SUM,
    "ordinal_codes": "SELECT p_partkey AS row_id, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS code FROM part",
}
