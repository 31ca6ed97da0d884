"""Shapley values by permutation sampling, for any model that scores a DataFrame.

For each row and permutation the features are switched from the background's values to the row's, one after the other; what each switch adds
to the score is its contribution. A permutation's contributions add up to score(row) - score(background) exactly. All coalitions of all rows are
scored by one call of the model, so the work is spread like any other prediction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retort.operators.splits import seeded_hash


def shapley_values(rows: DataFrame, background: list[float], score: Callable[[DataFrame], DataFrame], n_permutations: int = 8, seed: int = 42) -> DataFrame:
    """rows: row_id, features (array). score: row_id, features -> row_id, value. -> row_id, expected_value, prediction, shap (array)."""
    n = len(background)
    if n_permutations < 1 or not n:
        raise ValueError("n_permutations and the number of features must be positive")
    base = F.array(*[F.lit(float(v)) for v in background])
    perms = F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1)))
    d = rows.select("row_id", "features", perms.alias("perm"))
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(seeded_hash(seed, F.col("row_id"), F.col("perm"), i).alias("h"), i.alias("i")))), lambda x: x["i"])
    d = d.withColumn("order", order).select("row_id", "perm", "features", "order", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.array_contains(F.slice("order", 1, F.col("k")), i), F.get("features", i)).otherwise(F.get(base, i)))
    d = d.select(F.struct("row_id", "perm", "k", F.get("order", F.col("k") - 1).alias("feature")).alias("at"), mixed.alias("features"))
    s = score(d.select(F.col("at").alias("row_id"), "features")).select("row_id.*", "value")
    gain = F.col("value") - F.lag("value").over(Window.partitionBy("row_id", "perm").orderBy("k"))
    s = s.withColumn("gain", gain)
    ends = s.groupBy("row_id").agg(F.avg(F.when(F.col("k") == 0, F.col("value"))).alias("expected_value"), F.avg(F.when(F.col("k") == n, F.col("value"))).alias("prediction"))
    phi = s.where("k > 0").groupBy("row_id", "feature").agg(F.avg("gain").alias("phi"))
    shap = phi.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "phi"))), lambda x: x["phi"]).alias("shap"))
    return ends.join(shap, "row_id").select("row_id", "expected_value", "prediction", "shap")


def valid_explanations(df: DataFrame, required: tuple[str, ...] = ("prediction", "shap")) -> DataFrame:
    """Adds ``is_valid``: nothing required is null."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return df.withColumn("is_valid", ok)
