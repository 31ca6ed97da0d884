"""Fitted pipelines, own steps, new options of the kernel, helpers."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from retort.chem import features as X
from retort.chem import reaction as R
from retort.chem import standardize as S
from retort.chem.mol import MolError
from retort.chem.smiles import parse_smarts, parse_smiles, to_smiles
from retort.functions import helpers
from retort.operators import numbering, similarity, splits
from retort.plans import pipeline as P
from retort.plans.plan import Plan, Step, register_output, register_step

SIZE = Plan(Step.of("read", "smiles"), (), (Step.of("d", "descriptors", names=["HeavyAtomCount"]), Step.of("q", "net_charge")))


def molecules(spark):
    rows = [(i, "C" * (i + 1), 2.0 * (i + 1) + 1) for i in range(8)] + [(90, "C1C", 5.0), (91, None, 5.0)]
    return spark.createDataFrame(rows, "row_id long, input string, y double")


def test_fit_predict_save_load(spark, tmp_path):
    d = molecules(spark)
    p = P.Pipeline(SIZE, ("d",), LinearRegression(featuresCol="features", labelCol="y", solver="normal"), (("clip", {"lo": 4.0}), ("scale", {"factor": 2.0, "shift": 1.0}), ("round", {"digits": 3})), fill=-7.0)
    with pytest.raises(ValueError):
        p.predict(d)
    f = p.fit(d)
    assert not p.fitted and p.model is None
    want = {i: round(2 * max(4.0, 2.0 * (i + 1) + 1) + 1, 3) for i in range(8)} | {90: -7.0, 91: -7.0}
    f.save(spark, str(tmp_path / "m"))
    again = P.Pipeline.load(spark, str(tmp_path / "m"))
    for m in (f, again):
        assert {r.row_id: r.prediction for r in m.predict(d).collect()} == pytest.approx(want)
    assert again.plan == f.plan and again.moments == f.moments
    x = np.arange(1, 9)
    got = {r.row_id: r.features for r in again.transform(d).collect()}
    assert [got[i][0] for i in range(8)] == pytest.approx(((x - x.mean()) / x.std()).tolist())
    with pytest.raises(ValueError):
        P.Pipeline(SIZE, ("nope",))
    with pytest.raises(ValueError):
        P.Pipeline(SIZE, post=(("nope", {}),))
    assert {r.row_id for r in P.Pipeline(SIZE, (), LinearRegression(featuresCol="features", labelCol="y"), reinsert=False).fit(d).predict(d).collect()} == set(range(8))


def test_own_steps_and_outputs(spark):
    register_step("at_least", lambda n=2: lambda m: m if len(m.atoms) >= n else (_ for _ in ()).throw(MolError("too small")))
    register_output("twice", "double", lambda: lambda m: 2.0 * len(m.atoms))
    plan = Plan(Step.of("read", "smiles"), (Step.of("big", "at_least", n=3),), (Step.of("t", "twice"),))
    assert Plan.from_json(plan.to_json()) == plan
    got = {r.row_id: (r.t, r.err.element_id if r.err else None) for r in plan.apply(molecules(spark)).collect()}
    assert got[0] == (None, "big") and got[5] == (12.0, None) and got[90] == (None, "read")
    custom = Plan(Step.of("read", "smiles"), (Step.of("odd", "custom_filter", test=lambda m: len(m.atoms) % 2 == 1),), (Step.of("ok", "bool"),))
    assert {r.row_id for r in custom.apply(molecules(spark)).where("ok").collect()} == {0, 2, 4, 6}
    with pytest.raises(ValueError):
        custom.to_json()
    with pytest.raises(ValueError):
        register_step("murcko", lambda: None)
    with pytest.raises(ValueError):
        register_output("x", "no such type", lambda: None)


def test_recursive_patterns():
    for text, pattern, n in [("CCC(=O)O", "[$(C(=O)[O;!H0])]", 1), ("CC(=O)OC", "[$(C(=O)[O;!H0])]", 0), ("CCO", "[C;!$(CO)]", 1), ("CC(N)C(=O)O", "[N;$(NC[$(C=O)])]", 1), ("c1ccccc1O", "[$(cO),$(c)]", 6)]:
        assert len(parse_smarts(pattern).matches(parse_smiles(text))) == n, (text, pattern)
    for bad in ("[$(C]", "[$()]", "[$(C)"):
        with pytest.raises(MolError):
            parse_smarts(bad)
    with pytest.raises(MolError):  # never a lower count
        parse_smarts("CC").matches(parse_smiles("C" * 30), limit=10)


def brute_subgraphs(m, least, most):
    """All connected sets of bonds by trying every set."""
    from itertools import combinations

    out = []
    for n in range(least, most + 1):
        for s in combinations(range(len(m.bonds)), n):
            left, seen = set(s), {s[0]}
            while grown := {k for k in left - seen for q in seen if {m.bonds[k].a, m.bonds[k].b} & {m.bonds[q].a, m.bonds[q].b}}:
                seen |= grown
            out += [s] * (seen == left)
    return len(out)


def test_path_options():
    for text in ("CC(C)C(=O)O", "c1ccccc1C", "C1CC1C"):
        m = parse_smiles(text)
        total = lambda **kw: sum(X.path_fingerprint(m, counted=True, bits_per_feature=1, **kw).values())  # noqa: E731, B023
        assert total(use_hs=False, max_path=4) == brute_subgraphs(m, 1, 4)
        assert total(use_hs=False, max_path=1) == len(m.bonds) and total(max_path=1) == len(m.bonds) + X.n_hydrogens(m)
        counts = X.path_fingerprint(m, n_bits=64, counted=True, use_hs=False)
        sim = X.path_fingerprint(m, n_bits=256, count_simulation=True, use_hs=False)
        assert sim == {b * 4 + i: 1 for b, c in counts.items() for i, k in enumerate((1, 2, 4, 8)) if c >= k}
    with pytest.raises(ValueError):
        X.path_fingerprint(parse_smiles("CC"), n_bits=2, count_simulation=True)


def test_feature_invariants_and_pharmacophores():
    a, b = parse_smiles("CCO"), parse_smiles("CCN")
    assert X.morgan(a, 0, use_features=True).keys() == X.morgan(parse_smiles("CCCO"), 0, use_features=True).keys()
    assert X.morgan(a).keys() != X.morgan(b).keys()
    text = "DefineFeature OneO [O;!H0]\nFamily oxygen\nEndFeature\nDefineFeature N [N]\nFamily nitrogen\nEndFeature\n"
    assert X.read_definitions(text) == {"oxygen": ["[O;!H0]"], "nitrogen": ["[N]"]} == X.read_definitions('{"oxygen": "[O;!H0]", "nitrogen": ["[N]"]}')
    with pytest.raises(ValueError):
        X.read_definitions("DefineFeature x [O]\n")
    m = parse_smiles("OCCNCCO")
    every, pairs = X.pharmacophore(m), X.pharmacophore(m, most_points=2)
    triples = X.pharmacophore(m, least_points=3)
    assert set(pairs) | set(triples) == set(every) and not set(pairs) & set(triples)
    assert set(every) <= set(X.pharmacophore(m, triangular_pruning=False))
    assert X.pharmacophore(m, skip_features=tuple(X.FEATURES)) == {}


def test_descriptors_against_published_values():
    d = lambda s, *n: X.descriptors(parse_smiles(s), list(n))
    assert d("CC(C)C", "Chi0", "Chi1") == pytest.approx([3 + 3**-0.5, 3 * 3**-0.5])
    assert d("c1ccccc1", "Kappa1", "HallKierAlpha") == pytest.approx([3.4116708, -0.78], abs=1e-4)
    assert d("C1CCC2(CC1)CCCCC2", "NumSpiroAtoms", "NumBridgeheadAtoms") == [1, 0] and d("C1CC2CCC1C2", "NumSpiroAtoms", "NumBridgeheadAtoms") == [0, 2]
    assert d("CC(=O)NC", "NumAmideBonds") == [1] and d("C1CCNCC1", "NumSaturatedHeterocycles", "NumHeterocycles", "NumSaturatedCarbocycles") == [1, 1, 0]


def test_hashes_and_tautomers():
    dedup = lambda s, h: to_smiles(S.deduplicate_fragments(parse_smiles(s), h))
    assert len(S.HASHES) == 18
    assert dedup("CC(=O)O.CC(=O)[O-]", "HetAtomProtomer") == "CC(=O)O" and dedup("CC(=O)O.CC(=O)[O-]", "Mesomer") != "CC(=O)O"
    assert dedup("Cc1ccccc1C.Cc1ccc(C)cc1", "Regioisomer") == "Cc1ccccc1C" and dedup("CCO.CCN", "SmallWorldIndexBR") == "CCO"
    assert dedup("Cc1ccccc1.CCc1ccccc1", "ExtendedMurcko") == "Cc1ccccc1" and dedup("c1ccccc1.Cc1ccccc1", "ExtendedMurcko") == "Cc1ccccc1.c1ccccc1"
    for most in (1, 2):  # too many is an error whichever form is given
        for text in ("CC(=O)CC(C)=O", "CC(O)=CC(C)=O"):
            with pytest.raises(MolError):
                R.canonical_tautomer(parse_smiles(text), most)


def test_ranks_and_quantiles(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randint(0, 5), rng.randint(1, 9)) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, g string, v int, w int").repartition(7)
    got = {r.id: r for r in numbering.ranked(d, "g", [F.col("v"), F.col("id")], "w").collect()}
    for g in "ab":
        ordered, upto = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 0
        total = sum(r[3] for r in ordered)
        for k, r in enumerate(ordered):
            upto += r[3]
            assert (got[r[0]]["rank"], got[r[0]].n, got[r[0]].upto, got[r[0]].total) == (k + 1, len(ordered), upto, total)
    shares = [0, 0.1, 0.33, 0.5, 0.9, 1]
    assert numbering.quantiles(d, "w", shares) == pytest.approx(np.quantile([r[3] for r in rows], shares).tolist())
    assert numbering.quantiles(d.limit(0), "w", shares) == []


def test_knn_and_pairs_in_many_blocks(spark):
    rng = random.Random(5)
    fps = [(i, sorted(rng.sample(range(40), rng.randint(0, 12)))) for i in range(90)]
    d = spark.createDataFrame(fps, "row_id long, bits array<int>")
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0
    for k in (1, 4, None):
        got = {}
        for r in similarity.tanimoto_knn(d.where("row_id < 20"), d, k, 40, block_rows=7).orderBy("q_id", "rank").collect():
            got.setdefault(r.q_id, []).append((r.t_id, round(r.similarity, 9)))
        for i, bits in fps[:20]:
            every = sorted(((t, round(sim(bits, b), 9)) for t, b in fps), key=lambda x: (-x[1], -x[0] if k != 1 else x[0]))
            assert got[i] == every[: k or 90]
    want = {(i, j): sim(a, b) for i, a in fps for j, b in fps if i < j and sim(a, b) >= 0.3}
    got = {(r.a, r.b): r.sim for r in similarity._pairs_by_blocks(d, 0.3, 7).collect()}
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        similarity.tanimoto_knn(d, d, 1, 8)


def test_pair_bounds_survive_rounding(spark):
    a, b = list(range(100)), list(range(45, 100))  # 55 of 100, at 1 - 0.45 exactly
    d = spark.createDataFrame([(1, a), (2, b)], "row_id long, bits array<int>")
    for strategy in ("prefix", "blocks"):
        assert similarity.tanimoto_pairs(d, 1 - 0.45, strategy).count() == similarity.tanimoto_pairs(d, 0.55, strategy).count()


def test_group_shuffle_train_size(spark):
    d = spark.createDataFrame([(i, i // 3) for i in range(60)], "row_id long, grp long")
    for mode in ("groups", "samples"):
        got = splits.group_shuffle(d, 2, 0.25, mode, train_size=0.5).collect()
        for k in (0, 1):
            assert sum(r.split_id == k and r.role == "test" for r in got) == 15 and sum(r.split_id == k and r.role == "train" for r in got) == 30
    assert sum(r.role == "test" for r in splits.group_shuffle(d, 1, 4).collect()) == 12
    for bad in ({"test_size": 1.5}, {"test_size": 0.6, "train_size": 0.6}, {"test_size": 0}):
        with pytest.raises(ValueError):
            splits.group_shuffle(d, 1, **bad)


def test_helpers(spark, caplog):
    assert [helpers.check_cores(n, 8) for n in (1, 8, -1, -8)] == [1, 8, 8, 1]
    for bad in (0, -9):
        with pytest.raises(ValueError):
            helpers.check_cores(bad, 8)
    with pytest.warns(UserWarning):
        assert helpers.check_cores(99, 8) == 8
    with caplog.at_level("INFO"), helpers.elapsed_time("nothing"):
        pass
    assert "nothing took" in caplog.text
    a = spark.createDataFrame([(1, {1: 2}), (1, {1: 2}), (2, None)], "x int, m map<int,int>")
    assert helpers.are_equal(a, a.orderBy(F.desc("x"))) and not helpers.are_equal(a, a.dropDuplicates(["x"])) and not helpers.are_equal(a, a.drop("m"))
    assert helpers.n_clusters(spark.createDataFrame([(0.0,), (1.0,), (math.nan,), (None,), (1.0,)], "c double"), "c") == 2
