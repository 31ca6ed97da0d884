"""Molecule queries over a literal table, checked against known results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.operators.cluster import connected_component_clustering
from retort.functions.shared import checkpoint
from retort.operators.similarity import tanimoto_knn
from retort.operators.splits import ordinal_codes
from retort.plans.errors import error_filter, reinsert, rejected
from retort.plans.plan import Plan, Step

#: Inputs with what is known of them: text, elements H C N O S, formal charge, rings, scaffold.
MOLECULES = (
    ("CCO", (6, 2, 0, 1, 0), 0, 0, ""), ("CCN", (7, 2, 1, 0, 0), 0, 0, ""), ("c1ccccc1", (6, 6, 0, 0, 0), 0, 1, "c1ccccc1"), ("CS(=O)C", (6, 2, 0, 1, 1), 0, 0, ""),
    ("Cc1ccc(=O)[nH]c1", (7, 6, 1, 1, 0), 0, 1, "O=c1cccc[nH]1"), ("O=CC1CCC(c2ccccc2)CC1", (16, 13, 0, 1, 0), 0, 2, "c1ccc(C2CCCCC2)cc1"),
    ("C1=C-C=C-C=C1", (6, 6, 0, 0, 0), 0, 1, "c1ccccc1"), ("CC(=O)[O-]", (3, 2, 0, 2, 0), -1, 0, ""), ("C[NH+](C)C", (10, 3, 1, 0, 0), 1, 0, ""), ("[Fe+2]", (0, 0, 0, 0, 0), 2, 0, ""),
)
BAD = ("CCCXAS", "abc", "CC1CC", "no%valid~smiles", "cC")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a table of molecules: row_id, input; every seventh is not one."""
    good, bad = F.array(*[F.lit(m[0]) for m in MOLECULES]), F.array(*map(F.lit, BAD))
    k = F.col("p_partkey")
    text = F.when(k % 7 == 0, F.get(bad, (k % len(BAD)).cast("int"))).otherwise(F.get(good, (k % len(MOLECULES)).cast("int")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("row_id"), text.alias("input"))


READ = Step.of("read", "auto")
BASIC = Plan(READ, (), (Step.of("elements", "element_count", numbers=[1, 6, 7, 8, 16]), Step.of("charge", "net_charge"), Step.of("rings", "descriptors", names=["RingCount"]), Step.of("scaffold", "scaffold")))


def scaffold_clustering(df: DataFrame, make_generic: bool = False, linear_molecules_strategy: str = "ignore") -> DataFrame:
    """row_id, input -> row_id, code: molecules of one scaffold share a code (in order of the scaffolds' texts).

    Rows that cannot be read have none; nor have molecules without a ring ("ignore"), unless they form a cluster of their own ("own_cluster").
    """
    if linear_molecules_strategy not in ("ignore", "own_cluster"):
        raise ValueError("linear_molecules_strategy must be 'ignore' or 'own_cluster'")
    steps = (Step.of("scaffold", "murcko"), *((Step.of("generic", "generic_scaffold"), Step.of("again", "murcko")) if make_generic else ()))
    d = Plan(READ, steps, (Step.of("text", "smiles"),)).apply(df)
    linear = F.lit("linear") if linear_molecules_strategy == "own_cluster" else F.lit(None).cast("string")
    return ordinal_codes(d.select("row_id", F.when(F.col("text") == "", linear).otherwise(F.col("text")).alias("text")), "text")


def q_features(spark, sf_dir):
    d = error_filter(BASIC.apply(molecules(spark, sf_dir)))
    return d.select("row_id", *[F.get("elements", F.lit(i)).alias(c) for i, c in enumerate(("n_h", "n_c", "n_n", "n_o", "n_s"))], "charge", F.get("rings", F.lit(0)).alias("n_rings"), "scaffold")


def q_errors(spark, sf_dir):
    r = rejected(BASIC.apply(molecules(spark, sf_dir)))
    return r.groupBy("element_id").agg(F.count("*").alias("n"))


def q_reinsert(spark, sf_dir):
    m = molecules(spark, sf_dir)
    ok = error_filter(BASIC.apply(m)).select("row_id", "charge")
    return reinsert(m, ok, {"charge": -99.0})


def q_filter(spark, sf_dir):
    p = Plan(READ, (Step.of("elements", "element_filter"), Step.of("one", "mixture_filter"), Step.of("organic", "inorganics_filter"), Step.of("ring", "smarts_filter", patterns=["[R]"])), (Step.of("ok", "bool"),))
    return p.apply(molecules(spark, sf_dir)).select("row_id", "ok")


def q_standardize(spark, sf_dir):
    p = Plan(READ, tuple(Step.of(n, n) for n in ("disconnect_metals", "largest_fragment", "uncharge", "remove_isotopes", "remove_stereo")), (Step.of("smiles", "smiles"),))
    return error_filter(p.apply(molecules(spark, sf_dir))).groupBy("smiles").agg(F.count("*").alias("n"))


def q_scaffold_clusters(spark, sf_dir):
    return scaffold_clustering(molecules(spark, sf_dir))


def fingerprint_classes(spark, sf_dir):
    """row_id, class, bits of every row of molecules that can be read; class is the least row_id of those with the same fingerprint."""
    f = checkpoint(Plan(READ, (), (Step.of("bits", "morgan_bits"),)).apply(molecules(spark, sf_dir)).where("err IS NULL").select("row_id", "bits"))
    least = f.groupBy("bits").agg(F.min("row_id").alias("class"))
    return f.join(least.withColumnRenamed("bits", "b"), F.col("bits") == F.col("b")).select("row_id", "class", "bits")


def q_molecule_knn(spark, sf_dir):
    """The two nearest classes (t_id, its least row_id) of every row; its own class is class, whose members are the rows with that value."""
    c = checkpoint(fingerprint_classes(spark, sf_dir))
    f = c.where("row_id = class").select("row_id", "bits")
    near = tanimoto_knn(f, f, 2, 2048).withColumnRenamed("q_id", "class")
    return c.select("row_id", "class").join(near, "class").select(F.col("row_id").alias("q_id"), "class", F.col("rank").cast("long").alias("rank"), "t_id", F.round("similarity", 6).alias("similarity"))


def q_molecule_components(spark, sf_dir):
    c = checkpoint(fingerprint_classes(spark, sf_dir))
    found = connected_component_clustering(c.where("row_id = class").select("row_id", "bits"), 0.2).withColumnRenamed("row_id", "class")
    return c.select("row_id", "class").join(found, "class").select("row_id", F.col("cluster").cast("long").alias("cluster"))


QUERIES = {
    "molecule_features": q_features, "molecule_errors": q_errors, "molecule_reinsert": q_reinsert, "molecule_filters": q_filter, "molecule_standardize": q_standardize,
    "scaffold_clusters": q_scaffold_clusters, "molecule_knn": q_molecule_knn, "molecule_components": q_molecule_components,
}
_VALUES = "m(k, h, c, n, o, s, q, rings, scaffold) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(str, e))}, {q}, {r}, '{sc}')" for i, (_, e, q, r, sc) in enumerate(MOLECULES)) + ")"
_ROWS = f"WITH {_VALUES}, r AS (SELECT p_partkey AS row_id, p_partkey % 7 = 0 AS bad, p_partkey % {len(MOLECULES)} AS k FROM part) "
_GOOD = "FROM r JOIN m USING (k) WHERE NOT bad"
ORACLE_SQL = {
    "molecule_features": _ROWS + "SELECT row_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {a}" for c, a in (("h", "n_h"), ("c", "n_c"), ("n", "n_n"), ("o", "n_o"), ("s", "n_s"), ("q", "charge"), ("rings", "n_rings"))) + f", scaffold {_GOOD}",
    "molecule_errors": _ROWS + "SELECT 'read' AS element_id, count(*) AS n FROM r WHERE bad",
    "molecule_reinsert": _ROWS + "SELECT row_id, CASE WHEN bad THEN -99.0 ELSE CAST(q AS DOUBLE) END AS charge FROM r JOIN m USING (k)",
    "molecule_filters": _ROWS + "SELECT row_id, NOT bad AND rings > 0 AS ok FROM r JOIN m USING (k)",
    "scaffold_clusters": _ROWS + "SELECT row_id, CASE WHEN bad OR scaffold = '' THEN NULL ELSE CAST((SELECT count(DISTINCT x.scaffold) FROM m x WHERE x.scaffold <> '' AND x.scaffold < m.scaffold) AS DOUBLE) END AS code FROM r JOIN m USING (k)",
    "molecule_standardize": _ROWS + "SELECT CASE k WHEN 0 THEN 'CCO' WHEN 1 THEN 'CCN' WHEN 2 THEN 'c1ccccc1' WHEN 3 THEN 'CS(C)=O' WHEN 4 THEN 'Cc1ccc(=O)[nH]c1' WHEN 5 THEN 'O=CC1CCC(c2ccccc2)CC1' WHEN 6 THEN 'c1ccccc1' WHEN 7 THEN 'CC(=O)O' WHEN 8 THEN 'CN(C)C' ELSE '[Fe+2]' END AS smiles, count(*) AS n " + _GOOD + " GROUP BY 1",
}
