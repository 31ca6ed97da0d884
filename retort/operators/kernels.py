"""Gaussian-process kernels on similarities, attribution of fingerprint weights to atoms, and sums of Gaussians on a grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retort.operators.similarity import _BITS, sign_bits, to_training

#: Cells of a grid, which is broadcast.
MOST_CELLS = 1 << 16


def tanimoto_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense similarities of two blocks of count vectors, by the sparse formula."""
    dot = a @ b.T
    below = a.sum(1)[:, None] + b.sum(1)[None, :] - dot
    return np.divide(dot, below, out=np.zeros_like(dot, dtype=float), where=below != 0)


def exponential_tanimoto(a: np.ndarray, b: np.ndarray, exponent: float = 1.0, gradient: bool = False):
    """sim ** exponent; the gradient by the exponent is sim**e * log10(sim), taken as zero at similarity zero."""
    sim = tanimoto_matrix(a, b)
    k = sim**exponent
    if not gradient:
        return k
    log = np.log10(sim, out=np.zeros_like(sim), where=sim > 0)
    return k, (k * log)[:, :, None]


def kernel_frame(queries: DataFrame, training: DataFrame, exponent: float = 1.0) -> DataFrame:
    """The kernel between two tables of fingerprints in long form: q_id, t_id, k = similarity ** exponent, gradient by the exponent."""
    d = to_training(queries, training)
    k = F.pow("value", F.lit(float(exponent)))
    return d.select("q_id", "t_id", k.alias("k"), F.when(F.col("value") > 0, k * F.log10("value")).otherwise(0.0).alias("gradient"))


def gp_predict(x: np.ndarray, y: np.ndarray, new: np.ndarray, exponent: float = 1.0, noise: float = 1e-6, most_rows: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of a Gaussian process on the driver; bounded, since it solves a dense system."""
    if len(x) > most_rows:
        raise ValueError(f"at most {most_rows} training rows")
    k = exponential_tanimoto(x, x, exponent) + noise * np.eye(len(x))
    ks = exponential_tanimoto(new, x, exponent)
    chol = np.linalg.cholesky(k)
    alpha = np.linalg.solve(chol.T, np.linalg.solve(chol, y))
    v = np.linalg.solve(chol, ks.T)
    return ks @ alpha, np.sqrt(np.maximum(1.0 - (v**2).sum(0), 0.0))


def atom_weights(envs: DataFrame, weights: DataFrame) -> DataFrame:
    """envs: row_id, bit, atoms (array), one row an environment. weights: row_id, bit, w -> row_id, atom, weight.

    The weight of a present bit is dealt evenly over its environments and their atoms, so a row's sum stays; absent bits count nothing.
    """
    # one shuffle by row and bit serves both; the hint keeps the weights, as many as set bits, from being sent to the driver for a broadcast
    n = envs.withColumn("n_env", F.count("*").over(Window.partitionBy("row_id", "bit")))
    d = n.join(weights.hint("merge"), ["row_id", "bit"])
    d = d.select("row_id", F.explode("atoms").alias("atom"), (F.col("w") / (F.col("n_env") * F.size("atoms"))).alias("w"))
    return d.groupBy("row_id", "atom").agg(F.sum("w").alias("weight"))


def present_and_absent(rows: DataFrame) -> DataFrame:
    """rows: row_id, x (0 or 1), w -> row_id, present, absent: sums of weights of bits that are set and of those that are not."""
    if rows.where("x NOT IN (0, 1)").limit(1).count():
        raise ValueError("features must be binary")
    return rows.groupBy("row_id").agg(F.sum(F.col("w") * F.col("x")).alias("present"), F.sum(F.col("w") * (1 - F.col("x"))).alias("absent"))


def gaussian_grid(atoms: DataFrame, cells: DataFrame, length: float = 0.7) -> DataFrame:
    """atoms: row_id, x, y, weight. cells: cx, cy (the fixed grid; broadcast) -> row_id, cx, cy, value: the sum of scaled Gaussians."""
    if cells.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise ValueError(f"a grid has at most {MOST_CELLS} cells")
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    return atoms.crossJoin(F.broadcast(cells)).groupBy("row_id", "cx", "cy").agg(F.sum(F.col("weight") * F.exp(-d2 / (2 * length**2))).alias("value"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))


def q_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sign_bits(spark, sf_dir)
    d = kernel_frame(f.where("row_id % 50 = 0"), f, 2.0)
    return d.groupBy("q_id").agg(F.round(F.sum("k"), 5).alias("k"), F.round(F.sum("gradient"), 5).alias("gradient"))


def q_present_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as weights of bits that are set where the next component is positive."""
    d = _rows(spark, sf_dir).select("row_id", F.posexplode(F.zip_with(F.slice("v", 1, 20), F.slice("v", 2, 20), lambda w, x: F.struct(w.alias("w"), (x > 0).cast("int").alias("x")))).alias("i", "c"))
    return present_and_absent(d.select("row_id", "c.x", "c.w")).select("row_id", F.round("present", 5).alias("present"), F.round("absent", 5).alias("absent"))


def q_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of each row as three weighted points, seen on a grid of nine cells."""
    v = F.col("v")
    points = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.get(v, 3 * i).alias("x"), F.get(v, 3 * i + 1).alias("y"), F.get(v, 3 * i + 2).alias("weight"))))
    atoms = _rows(spark, sf_dir).select("row_id", points.alias("p")).select("row_id", "p.*")
    cells = spark.range(9).select((F.col("id") % 3 - 1).cast("double").alias("cx"), (F.floor(F.col("id") / 3) - 1).cast("double").alias("cy"))
    return gaussian_grid(atoms, cells).select("row_id", "cx", "cy", F.round("value", 6).alias("value"))


QUERIES = {"tanimoto_kernel": q_kernel, "shap_present_absent": q_present_absent, "gaussian_grid": q_grid}
ORACLE_SQL = {
    "tanimoto_kernel": _BITS + "SELECT a AS q_id, round(sum(sim ** 2), 5) AS k, round(sum(CASE WHEN sim > 0 THEN sim ** 2 * log10(sim) ELSE 0 END), 5) AS gradient FROM s WHERE a % 50 = 0 GROUP BY a",
    "shap_present_absent": "WITH x AS (SELECT vec_id AS row_id, embedding[i]::DOUBLE AS w, (embedding[i + 1] > 0)::INT AS x FROM embeddings, range(1, 21) t(i)) SELECT row_id, round(sum(w * x), 5) AS present, round(sum(w * (1 - x)), 5) AS absent FROM x GROUP BY row_id",
    "gaussian_grid": "WITH p AS (SELECT vec_id AS row_id, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS w FROM embeddings, range(3) t(i)) "
    "SELECT row_id, cx, cy, round(sum(w * exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 0.7 ** 2))), 6) AS value FROM p, (SELECT a::DOUBLE AS cx FROM range(-1, 2) s(a)), (SELECT b::DOUBLE AS cy FROM range(-1, 2) u(b)) GROUP BY ALL",
}
