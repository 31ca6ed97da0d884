"""Molecule queries over part: each row a chain of its own length with a group at its end, 136 molecules in all, every eleventh row unreadable.

What comes out follows from how the molecule is put together, so SQL gets it by arithmetic and by joining texts, without reading any molecule.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.shared import shared_folder
from retort.operators.kernels import atom_weights
from retort.plans.errors import error_filter, rejected
from retort.plans.pipeline import Pipeline, fold_metrics
from retort.plans.plan import Plan, Step, dense, register_step, sparse
from retort.sources import readers
from retort.streaming.streams import file_stream, run_available

#: The groups: as written after the chain, as written before it; added hydrogens, C, N, O, S, Cl, Br; rings; atoms with OH.
GROUPS = (
    ("", "", 1, 0, 0, 0, 0, 0, 0, 0, 0), ("O", "O", 1, 0, 0, 1, 0, 0, 0, 0, 1), ("N", "N", 2, 0, 1, 0, 0, 0, 0, 0, 0), ("Cl", "Cl", 0, 0, 0, 0, 0, 1, 0, 0, 0), ("Br", "Br", 0, 0, 0, 0, 0, 0, 1, 0, 0),
    ("S", "S", 1, 0, 0, 0, 1, 0, 0, 0, 0), ("C(=O)O", "OC(=O)", 1, 1, 0, 2, 0, 0, 0, 0, 1), ("c1ccccc1", "c1ccccc1", 5, 6, 0, 0, 0, 0, 0, 1, 0),
)


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, chain, after and before (the group's texts), base (the molecule's canonical text), bad, y."""
    k = F.col("p_partkey")
    g = (F.floor(k / 17) % len(GROUPS)).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(x[i]) for x in GROUPS]), g)
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("row_id"), F.repeat(F.lit("C"), (2 + k % 17).cast("int")).alias("chain"), pick(0).alias("after"), pick(1).alias("before"), (k % 11 == 0).alias("bad"), F.col("p_retailprice").cast("double").alias("y"))
    return d.withColumn("base", F.concat("chain", "after"))


def _read(spark: SparkSession, sf_dir: str, text: Column, *keep: str) -> DataFrame:
    """row_id, input: the text, or one with an open ring."""
    return compounds(spark, sf_dir).select("row_id", F.when(F.col("bad"), F.concat(F.lit("C1"), "chain")).otherwise(text).alias("input"), *keep)


def _backwards() -> Column:
    return F.concat("before", "chain")


SMILES = Step.of("smiles", "smiles")


def q_canonical(spark, sf_dir):
    """Written from the other end, through the plan's JSON form."""
    plan = Plan.from_json(Plan(Step.of("read", "smiles"), (), (SMILES,)).to_json())
    return error_filter(plan.apply(_read(spark, sf_dir, _backwards()))).select("row_id", "smiles")


def q_binary(spark, sf_dir):
    b = error_filter(Plan(Step.of("read", "smiles"), (), (Step.of("bin", "binary"),)).apply(_read(spark, sf_dir, _backwards())))
    return error_filter(Plan(Step.of("read", "binary"), (), (SMILES,)).apply(b.select("row_id", F.col("bin").alias("input")))).select("row_id", "smiles")


def _sdf(c: Column, symbol: Column) -> Column:
    """An SDF record of a chain of c carbons and one more atom, bonded in a row."""
    n = c + 1
    atom = lambda s: F.concat(F.lit("    0.0000    0.0000    0.0000 "), F.rpad(s, 3, " "), F.lit(" 0  0"))
    atoms = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: atom(F.when(i == n, symbol).otherwise("C"))), "\n")
    bonds = F.array_join(F.transform(F.sequence(F.lit(1), c), lambda i: F.concat(F.lpad(i.cast("string"), 3, " "), F.lpad((i + 1).cast("string"), 3, " "), F.lit("  1  0"))), "\n")
    counts = F.concat(F.lpad(n.cast("string"), 3, " "), F.lpad(c.cast("string"), 3, " "), F.lit("  0  0  0  0  0  0  0  0999 V2000"))
    return F.concat(F.lit("name\n\n\n"), counts, F.lit("\n"), atoms, F.lit("\n"), bonds, F.lit("\nM  END\n> <kind>\nchain\n\n$$$$\n"))


def q_sdf(spark, sf_dir):
    """One-atom groups as SDF records, the rest as texts, both for the reader that finds out."""
    one = F.col("after").isin("O", "N", "Cl", "Br", "S")
    text = F.when(one, _sdf(F.length("chain"), F.col("after"))).otherwise(_backwards())
    return error_filter(Plan(Step.of("read", "auto"), (), (SMILES,)).apply(_read(spark, sf_dir, text))).select("row_id", "smiles")


def q_composition(spark, sf_dir):
    plan = Plan(Step.of("read", "smiles"), (), (Step.of("n", "element_count", numbers=[1, 6, 7, 8, 16, 17, 35]), Step.of("d", "descriptors", names=["HeavyAtomCount", "MolWt", "ExactMolWt", "RingCount", "NumHeteroatoms", "NumBonds", "FractionCSP3"])))
    d = error_filter(plan.apply(_read(spark, sf_dir, _backwards())))
    return d.select("row_id", *[F.get("n", F.lit(i)).alias(f"n_{s}") for i, s in enumerate(("h", "c", "n", "o", "s", "cl", "br"))],
                    *[F.round(F.get("d", F.lit(i)), 3).alias(s) for i, s in enumerate(("heavy", "weight", "exact", "rings", "hetero", "bonds", "sp3"))])


#: Standardising step -> (input, expected text), both over chain, base and after; expected null: the row fails.
_FRAGMENTS = {
    "largest_fragment": ("base || '.C'", "base"), "deduplicate_fragments": ("base || '.' || base", "base"), "remove_salts": ("base || '.[Na+].[Cl-]'", "base"),
    "remove_solvents": ("base || '.ClCCl.CS(=O)C'", "CASE WHEN base <> 'CCO' THEN base END"), "remove_solvents_of_mixtures": ("base", "base"),
}
_CHARGES = {
    "uncharge": ("chain || 'C(=O)[O-].' || chain || '[NH3+]'", "chain || 'C(=O)O.' || chain || 'N'"), "charge_parent": ("chain || 'C(=O)[O-].[Na+]'", "chain || 'C(=O)O'"),
    "disconnect_metals": ("chain || 'C(=O)O[Na]'", "chain || 'C(=O)[O-].[Na+]'"),
}
_ATOMS = {
    "remove_isotopes": ("'[13CH3]' || substr(base, 2)", "base"), "remove_stereo": ("chain || '[C@H](F)Cl'", "chain || 'C(F)Cl'"), "remove_explicit_hydrogens": ("'[H]' || base", "base"),
}
_SCAFFOLDS = {
    "murcko": ("'c1ccccc1' || chain || 'c1ccccc1'", "'c1ccc(' || chain || 'c2ccccc2)cc1'"),
    "generic_scaffold": ("'c1ccccc1' || chain || 'c1ccccc1'", "'C(' || repeat('C', length(chain) // 2) || 'C1CCCCC1)' || repeat('C', length(chain) - 1 - length(chain) // 2) || 'C1CCCCC1'"),
    "canonical_tautomer": ("'C=C(O)' || chain", "chain || 'C(C)=O'"),
}


def _q_steps(cases: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step on its own inputs: op, row_id, smiles."""
    out = None
    for op, (text, _) in cases.items():
        read = Step.of("read", "smiles", remove_hydrogens=op != "remove_explicit_hydrogens")
        d = error_filter(Plan(read, (Step.of("step", op),), (SMILES,)).apply(_read(spark, sf_dir, F.expr(text)))).select(F.lit(op).alias("op"), "row_id", "smiles")
        out = d if out is None else out.union(d)
    return out


_REACTIONS = (("alcohol", "chain || 'Br'", "[C:1][Br:2]>>[C:1][O:2]", (), "chain || 'O'"), ("amide", "chain || 'N'", "[C:1](=[O:2])[O;!H0].[N;!H0:3]>>[C:1](=[O:2])[N:3]", ("CC(=O)O",), "chain || 'NC(C)=O'"), ("none", "chain", "[C:1][Br:2]>>[C:1][O:2]", (), "NULL"))


def q_reactions(spark, sf_dir):
    out = None
    for name, text, reaction, additives, _ in _REACTIONS:
        step = Step.of("react", "reaction", reaction=reaction, additives=list(additives), handle_multi="pass")
        d = error_filter(Plan(Step.of("read", "smiles"), (step,), (SMILES,)).apply(_read(spark, sf_dir, F.expr(text)))).select(F.lit(name).alias("op"), "row_id", "smiles")
        out = d if out is None else out.union(d)
    return out


_OH = "[O;!H0]"
#: Filter -> (step and its parameters, what it keeps in SQL over c (chain), g (group), heavy).
FILTERS = {
    "smarts": (("smarts_filter", {"patterns": [_OH]}), "oh = 1"), "smarts_drop": (("smarts_filter", {"patterns": [_OH], "keep_matches": False}), "oh = 0"),
    "smarts_range": (("smarts_filter", {"patterns": {"C": [5, 10]}}), "c + (g = 6)::INT BETWEEN 5 AND 10"), "smarts_all": (("smarts_filter", {"patterns": {_OH: 1, "C": [None, 9]}, "mode": "all"}), "oh = 1 AND c + (g = 6)::INT <= 9"),
    "recursive": (("smarts_filter", {"patterns": ["[$(C(=O)[O;!H0])]"]}), "g = 6"), "recursive_not": (("smarts_filter", {"patterns": {"[C;!$(C=O);!$(CC=O)]": [3, None]}}), "c - (g = 6)::INT >= 3"),
    "smiles": (("smiles_filter", {"patterns": ["c1ccccc1"]}), "g = 7"), "descriptor": (("descriptor_filter", {"ranges": {"HeavyAtomCount": [5, 10]}}), "heavy BETWEEN 5 AND 10"),
    "descriptor_all": (("descriptor_filter", {"ranges": {"HeavyAtomCount": [5, 10], "RingCount": [1, None]}, "mode": "all"}), "heavy BETWEEN 5 AND 10 AND g = 7"),
    "complex_any": (("complex_filter", {"filters": {"oh": ["smarts_filter", {"patterns": [_OH]}], "size": ["descriptor_filter", {"ranges": {"HeavyAtomCount": [5, 10]}}]}}), "oh = 1 OR heavy BETWEEN 5 AND 10"),
    "complex_not_all": (("complex_filter", {"filters": {"oh": ["smarts_filter", {"patterns": [_OH]}], "size": ["descriptor_filter", {"ranges": {"HeavyAtomCount": [5, 10]}}]}, "keep_matches": False, "mode": "all"}), "NOT (oh = 1 AND heavy BETWEEN 5 AND 10)"),
    "element": (("element_filter", {"allowed": {"1": [None, 20], "6": [None, None], "8": [None, 1]}}), "g IN (0, 1, 7) AND h <= 20"), "even": (("even_atoms", {}), "heavy % 2 = 0"),
    "empty": (("empty_filter", {}), "true"), "mixture": (("mixture_filter", {}), "true"), "inorganic": (("inorganics_filter", {}), "true"), "passthrough": (("passthrough", {}), "true"),
}


def _even(m):
    return len(m.atoms) % 2 == 0


def _even_atoms():
    from retort.plans.plan import MOL_OPS

    return MOL_OPS["custom_filter"](_even, "odd number of atoms")


register_step("even_atoms", _even_atoms)  # a step of the user's own


def q_filters(spark, sf_dir):
    """row_id and the names of the filters that keep it."""
    out = None
    for name, ((op, params), _) in FILTERS.items():
        d = Plan(Step.of("read", "smiles"), (Step.of("f", op, **params),), (Step.of("ok", "bool"),)).apply(_read(spark, sf_dir, _backwards()))
        d = d.where("ok").select("row_id", F.lit(name).alias("filter"))
        out = d if out is None else out.union(d)
    return out


def q_error_steps(spark, sf_dir):
    """Errors by the element that made them, after several filters; and what is left when only some of them are filtered."""
    text = F.when(F.length("chain") % 2 == 0, F.lit("[Na+].[Cl-]")).otherwise(_backwards())
    plan = Plan(Step.of("read", "smiles"), (Step.of("salts", "remove_salts"), Step.of("empty", "empty_filter"), Step.of("oh", "smarts_filter", patterns=[_OH])), (SMILES,))
    d = plan.apply(_read(spark, sf_dir, text))
    by = rejected(d).groupBy("element_id").agg(F.count("*").alias("n"))
    some = error_filter(d, ["read", "empty"], False).agg(F.lit("left").alias("element_id"), F.count("*").alias("n"))
    return by.union(some)


def q_fingerprints(spark, sf_dir):
    """Of the bare chains: environments and paths, by counting; as maps, as dense vectors and back."""
    outputs = (Step.of("f0", "morgan", radius=0, counted=True), Step.of("f2", "morgan", counted=True), Step.of("bits", "morgan"), Step.of("paths", "path", counted=True, bits_per_feature=1, use_hs=False, branched_paths=False), Step.of("trees", "path", counted=True, bits_per_feature=1, use_hs=False), Step.of("shorts", "path", use_hs=False, branched_paths=False, min_path=2, max_path=3, counted=True, bits_per_feature=1))
    d = error_filter(Plan(Step.of("read", "smiles"), (), outputs).apply(_read(spark, sf_dir, F.col("chain"))))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, b: a + b)
    sums = [total(c).alias(n) for n, c in (("m0", "f0"), ("m2", "f2"), ("path", "paths"), ("tree", "trees"), ("short", "shorts"))]
    return d.select("row_id", *sums, (F.size("bits") == F.size("f2")).alias("same_bits"), (total(sparse(dense("f2", 2048))) == total("f2")).alias("same_dense"))


#: Fragment hashes; a fragment twice is once under any of them.
_HASHES = ("HetAtomTautomer", "CanonicalSmiles", "MolFormula", "AnonymousGraph", "ElementGraph", "AtomBondCounts", "NetCharge", "MurckoScaffold", "ExtendedMurcko", "DegreeVector", "Mesomer", "HetAtomProtomer", "RedoxPair",
           "Regioisomer", "SmallWorldIndexBR", "SmallWorldIndexBRL", "ArthorSubstructureOrder", "HetAtomTautomerv2")


def q_hashes(spark, sf_dir):
    out = None
    for name in _HASHES:
        plan = Plan(Step.of("read", "smiles"), (Step.of("d", "deduplicate_fragments", hashing=name),), (SMILES,))
        d = error_filter(plan.apply(_read(spark, sf_dir, F.expr("base || '.' || before || chain")))).select(F.lit(name).alias("hash"), "row_id", "smiles")
        out = d if out is None else out.union(d)
    return out


_TOPOLOGY = ("Chi0", "Chi1", "Chi0n", "Chi1n", "Chi2n", "Chi0v", "Kappa1", "Kappa2", "Kappa3", "Phi", "BalabanJ", "HallKierAlpha")


def q_topology(spark, sf_dir):
    """Indices of chains of four carbons and more, which have closed forms."""
    d = error_filter(Plan(Step.of("read", "smiles"), (), (Step.of("d", "descriptors", names=list(_TOPOLOGY)),)).apply(_read(spark, sf_dir, F.expr("'CC' || chain"))))
    return d.select("row_id", *[(F.round(F.get("d", F.lit(i)), 4) + F.lit(0.0)).alias(n.lower()) for i, n in enumerate(_TOPOLOGY)])


def q_atom_weights(spark, sf_dir):
    """Weights of bits dealt over the atoms of their environments: nothing is lost, and every atom of the chain has a share."""
    d = error_filter(Plan(Step.of("read", "smiles"), (), (Step.of("e", "morgan_atoms"),)).apply(_read(spark, sf_dir, F.col("chain"))))
    envs = d.select("row_id", F.explode("e").alias("e")).select("row_id", "e.bit", "e.atoms")
    weights = envs.groupBy("row_id", "bit").agg(F.count("*").cast("double").alias("w"))
    return atom_weights(envs, weights).groupBy("row_id").agg(F.round(F.sum("weight"), 6).alias("total"), F.count("*").alias("atoms"))


def q_table_file(spark, sf_dir):
    """Written as a tab-separated file with a header, and read back."""
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _read(spark, sf_dir, _backwards()).select(F.col("row_id").alias("key"), F.col("input").alias("smiles")).write.option("header", True).csv(folder, sep="\t")
    d = error_filter(Plan(Step.of("read", "smiles"), (), (SMILES,)).apply(readers.read_table(spark, folder, "smiles"), keep=("key",)))
    return d.select(F.col("key").cast("long").alias("row_id"), "smiles")


def q_sdf_file(spark, sf_dir):
    """One-atom groups written as an SDF file and read back by records."""
    folder = f"{shared_folder(spark)}/sdf-{uuid.uuid4().hex}"
    d = compounds(spark, sf_dir).where(~F.col("bad") & F.col("after").isin("O", "N", "Cl", "Br", "S"))
    d.select(F.rtrim(_sdf(F.length("chain"), F.col("after")), F.lit("\n")).alias("value")).write.text(folder)
    out = error_filter(Plan(Step.of("read", "sdf"), (), (SMILES,)).apply(readers.read_sdf(spark, folder)))
    return out.groupBy("smiles").agg(F.count("*").alias("n"))


def q_stream(spark, sf_dir):
    """The plan on a stream of part, error rows kept as values."""
    part = file_stream(spark, sf_dir, "part.parquet")
    k = F.col("p_partkey")
    text = F.when(k % 11 == 0, "C1CC").otherwise(F.concat(F.lit("O"), F.repeat(F.lit("C"), (2 + k % 17).cast("int"))))
    return run_available(Plan(Step.of("read", "smiles"), (), (SMILES,)).apply(part.select(k.alias("row_id"), text.alias("input"))).select("row_id", "smiles", F.col("err.element_id").alias("failed_at")))


def q_concat(spark, sf_dir):
    parts = [["descriptors", {"names": ["HeavyAtomCount", "RingCount"]}], ["element_count", {"numbers": [6, 8]}], ["net_charge", {}], ["net_charge", {"method": "gasteiger"}]]
    plan = Plan(Step.of("read", "smiles"), (), (Step.of("v", "concat", parts=parts),))
    d = error_filter(plan.apply(_read(spark, sf_dir, F.expr("chain || 'C(=O)[O-].' || base"))))
    return d.select("row_id", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("v"))


_SIZES = Plan(Step.of("read", "smiles"), (), (Step.of("d", "descriptors", names=["HeavyAtomCount", "RingCount"]), Step.of("n", "element_count", numbers=[1, 8])))


def q_standardized(spark, sf_dir):
    """Descriptors less mean by population deviation, fitted over the readable rows; counts as they are."""
    d = _read(spark, sf_dir, _backwards())
    f = Pipeline(_SIZES, scaled=("d",)).fit(d).transform(d)
    return f.select("row_id", *[F.round(F.get("features", F.lit(i)), 4).alias(n) for i, n in enumerate(("heavy", "rings", "n_h", "n_o"))])


def _regression(spark: SparkSession, sf_dir: str) -> tuple[Pipeline, DataFrame]:
    d = _read(spark, sf_dir, _backwards(), "y")
    plan = Plan(Step.of("read", "smiles"), (), (Step.of("d", "descriptors", names=["HeavyAtomCount"]),))
    line = LinearRegression(featuresCol="features", labelCol="y", solver="normal")
    return Pipeline(plan, ("d",), line, (("scale", {"factor": 0.001}), ("clip", {"lo": 1.4, "hi": 1.6}), ("round", {"digits": 3})), fill=-1.0).fit(d), d


def q_regression(spark, sf_dir):
    """y by the size of the molecule; scaled, clipped and rounded after prediction; unreadable rows take the fill value."""
    p, d = _regression(spark, sf_dir)
    return p.predict(d)


def q_reloaded(spark, sf_dir):
    """The same, by a pipeline that was saved and loaded."""
    p, d = _regression(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    p.save(spark, folder)
    return Pipeline.load(spark, folder).predict(d)


def q_fold_metrics(spark, sf_dir):
    """Error of a constant prediction, fold by fold: mean and deviation of the folds' scores."""
    d = compounds(spark, sf_dir).select((F.col("row_id") % 5).alias("fold"), "y", F.lit(1500.0).alias("pred"))
    m = fold_metrics(d, {"mae": F.avg(F.abs(F.col("y") - F.col("pred"))), "rmse": F.sqrt(F.avg((F.col("y") - F.col("pred")) ** 2))})
    return m.select("metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


QUERIES = {
    "compound_canonical": q_canonical, "compound_binary": q_binary, "compound_sdf": q_sdf, "compound_composition": q_composition, "compound_fragments": partial(_q_steps, _FRAGMENTS), "compound_charges": partial(_q_steps, _CHARGES),
    "compound_atoms": partial(_q_steps, _ATOMS), "compound_scaffolds": partial(_q_steps, _SCAFFOLDS), "compound_reactions": q_reactions, "compound_filters": q_filters, "compound_error_steps": q_error_steps,
    "compound_hashes": q_hashes, "compound_topology": q_topology, "atom_weights": q_atom_weights, "reader_table_file": q_table_file, "reader_sdf_file": q_sdf_file, "compound_stream": q_stream,
    "compound_fingerprints": q_fingerprints, "compound_concat": q_concat, "pipeline_standardized": q_standardized, "pipeline_regression": q_regression, "pipeline_reloaded": q_reloaded, "fold_metrics": q_fold_metrics,
}

_M = (
    "WITH t(g, after, before, dh, dc, nn, no, ns, ncl, nbr, rings, oh) AS (VALUES " + ", ".join(f"({i}, '{x[0]}', '{x[1]}', {', '.join(map(str, x[2:]))})" for i, x in enumerate(GROUPS)) + "), "
    "p AS (SELECT p_partkey AS row_id, p_partkey % 11 = 0 AS bad, 2 + p_partkey % 17 AS c, (p_partkey // 17) % 8 AS g, repeat('C', CAST(2 + p_partkey % 17 AS INT)) AS chain, CAST(p_retailprice AS DOUBLE) AS y FROM part), "
    "a AS (SELECT *, chain || after AS base, c + dc AS nc, 2 * c + 1 + dh AS h, c + dc + nn + no + ns + ncl + nbr AS heavy FROM p JOIN t USING (g)), m AS (SELECT * FROM a WHERE NOT bad) "
)
_LINE = "r AS (SELECT regr_slope(y, heavy) AS s, regr_intercept(y, heavy) AS i FROM m)"
_PREDICTED = _M + ", " + _LINE + " SELECT row_id, CASE WHEN bad THEN -1.0 ELSE round(least(greatest(0.001 * (i + s * heavy), 1.4), 1.6), 3) END AS prediction FROM a, r"


def _steps_sql(cases: dict) -> str:
    return _M + " UNION ALL ".join(f"SELECT '{op}' AS op, row_id, {want} AS smiles FROM m WHERE {want} IS NOT NULL" for op, (_, want) in cases.items())


ORACLE_SQL = {
    **dict.fromkeys(("compound_canonical", "compound_binary", "compound_sdf"), _M + "SELECT row_id, base AS smiles FROM m"),
    "compound_composition": _M + "SELECT row_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS n_{n}" for n, e in (("h", "h"), ("c", "nc"), ("n", "nn"), ("o", "no"), ("s", "ns"), ("cl", "ncl"), ("br", "nbr")))
    + ", CAST(heavy AS DOUBLE) AS heavy, round(1.008 * h + 12.011 * nc + 14.007 * nn + 15.999 * no + 32.067 * ns + 35.453 * ncl + 79.904 * nbr, 3) AS weight, "
    "round(1.00782503207 * h + 12.0 * nc + 14.0030740048 * nn + 15.99491461956 * no + 31.972071 * ns + 34.96885268 * ncl + 78.9183371 * nbr, 3) AS exact, CAST(rings AS DOUBLE) AS rings, "
    "CAST(nn + no + ns + ncl + nbr AS DOUBLE) AS hetero, CAST(heavy - 1 + rings AS DOUBLE) AS bonds, round(c / nc, 3) AS sp3 FROM m",
    "compound_fragments": _steps_sql(_FRAGMENTS), "compound_charges": _steps_sql(_CHARGES), "compound_atoms": _steps_sql(_ATOMS), "compound_scaffolds": _steps_sql(_SCAFFOLDS),
    "compound_reactions": _M + " UNION ALL ".join(f"SELECT '{n}' AS op, row_id, {w} AS smiles FROM m" for n, *_, w in _REACTIONS if w != "NULL"),
    "compound_filters": _M + " UNION ALL ".join(f"SELECT row_id, '{n}' AS filter FROM m WHERE {w}" for n, (_, w) in FILTERS.items()),
    "compound_error_steps": _M + ", e AS (SELECT CASE WHEN bad THEN 'read' WHEN c % 2 = 0 THEN 'empty' WHEN oh = 0 THEN 'oh' END AS element_id FROM a) SELECT element_id, count(*) AS n FROM e WHERE element_id IS NOT NULL GROUP BY 1 "
    "UNION ALL SELECT 'left', count(*) FROM e WHERE element_id IS NULL OR element_id = 'oh'",
    "compound_fingerprints": _M + "SELECT row_id, c AS m0, CASE WHEN c = 2 THEN 3 WHEN c = 3 THEN 6 WHEN c = 4 THEN 9 ELSE 3 * c - 2 END AS m2, CAST((SELECT sum(c - l) FROM range(1, 8) x(l) WHERE l < c) AS BIGINT) AS path, CAST((SELECT sum(c - l) FROM range(1, 8) x(l) WHERE l < c) AS BIGINT) AS tree, "
    "CAST(greatest(c - 2, 0) + greatest(c - 3, 0) AS BIGINT) AS short, true AS same_bits, true AS same_dense FROM m",
    "compound_hashes": _M + "SELECT unnest([" + ", ".join(f"'{h}'" for h in _HASHES) + "]) AS hash, row_id, base AS smiles FROM m",
    "compound_topology": "WITH m AS (SELECT p_partkey AS row_id, 4 + p_partkey % 17 AS c FROM part WHERE p_partkey % 11 <> 0), x AS (SELECT row_id, c::DOUBLE AS c, 2 + (c - 2) / sqrt(2) AS chi0, 2 / sqrt(2) + (c - 3) / 2 AS chi1, 1 + (c - 4) / sqrt(8) AS chi2, c % 2 = 1 AS odd, "
    "(c - 1) * (SELECT sum(1 / sqrt(((i * (i - 1) + (c - i) * (c - i + 1)) / 2) * ((i * (i + 1) + (c - i - 1) * (c - i)) / 2))) FROM range(1, 21) t(i) WHERE i < c) AS j FROM m) "
    "SELECT row_id, round(chi0, 4) AS chi0, round(chi1, 4) AS chi1, round(chi0, 4) AS chi0n, round(chi1, 4) AS chi1n, round(chi2, 4) AS chi2n, round(chi0, 4) AS chi0v, c AS kappa1, c - 1 AS kappa2, "
    "round(CASE WHEN odd THEN c - 1 ELSE (c - 2) ** 2 / (c - 3) END, 4) AS kappa3, c - 1 AS phi, round(j, 4) AS balabanj, 0.0::DOUBLE AS hallkieralpha FROM x",
    "atom_weights": _M + "SELECT row_id, CAST(CASE WHEN c = 2 THEN 3 WHEN c = 3 THEN 6 WHEN c = 4 THEN 9 ELSE 3 * c - 2 END AS DOUBLE) AS total, c AS atoms FROM m",
    "reader_table_file": _M + "SELECT row_id, base AS smiles FROM m", "reader_sdf_file": _M + "SELECT base AS smiles, count(*) AS n FROM m WHERE g BETWEEN 1 AND 5 GROUP BY 1",
    "compound_stream": "SELECT p_partkey AS row_id, CASE WHEN p_partkey % 11 <> 0 THEN repeat('C', CAST(2 + p_partkey % 17 AS INT)) || 'O' END AS smiles, CASE WHEN p_partkey % 11 = 0 THEN 'read' END AS failed_at FROM part",
    "compound_concat": _M + "SELECT row_id, concat_ws(',', heavy + c + 3, rings, nc + c + 1, no + 2, -1, -1) AS v FROM m",
    "pipeline_standardized": _M + "SELECT row_id, round((heavy - avg(heavy) OVER ()) / stddev_pop(heavy) OVER (), 4) AS heavy, round((rings - avg(rings) OVER ()) / stddev_pop(rings) OVER (), 4) AS rings, CAST(h AS DOUBLE) AS n_h, CAST(no AS DOUBLE) AS n_o FROM m",
    "pipeline_regression": _PREDICTED, "pipeline_reloaded": _PREDICTED,
    "fold_metrics": "WITH f AS (SELECT p_partkey % 5 AS fold, avg(abs(p_retailprice - 1500.0)) AS mae, sqrt(avg((p_retailprice - 1500.0) ** 2)) AS rmse FROM part GROUP BY 1) "
    "SELECT 'mae' AS metric, round(avg(mae), 4) AS mean, round(stddev_pop(mae), 4) AS std FROM f UNION ALL SELECT 'rmse', round(avg(rmse), 4), round(stddev_pop(rmse), 4) FROM f",
}
