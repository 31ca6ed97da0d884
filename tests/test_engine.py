"""Plans, errors, splitters, similarity, clustering, conformal prediction and models on small inputs."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.functions import timeutil as T
from retort.operators import cluster, conformal, explain, kernels, models, similarity, splits, stats
from retort.operators.components import connected_components
from retort.plans.errors import error_filter, failed, is_valid, reinsert, rejected
from retort.plans.plan import Plan, Step
from retort.streaming import streams


def molecules(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, input string")


PLAN = Plan(Step.of("read", "smiles"), (Step.of("whole", "empty_filter"), Step.of("salts", "remove_salts")), (Step.of("smiles", "smiles"), Step.of("ok", "bool"), Step.of("fp", "morgan")))


def test_plan_keeps_errors_as_data(spark):
    d = PLAN.apply(molecules(spark, ["NCCCO", "abc", "c1ccccc1", "", None])).cache()
    assert [(r.smiles, r.ok) for r in d.orderBy("row_id").collect()] == [("NCCCO", True), (None, False), ("c1ccccc1", True), (None, False), (None, False)]
    assert {(r.row_id, r.element_id) for r in rejected(d).collect()} == {(1, "read"), (3, "whole"), (4, "read")}
    assert error_filter(d, ["read"]).count() == 3 and error_filter(d).count() == 2 and d.where(is_valid()).count() == 2
    back = reinsert(d, error_filter(d).select("row_id", F.lit(1.0).alias("p")), {"p": 42.0}).orderBy("row_id")
    assert [r.p for r in back.collect()] == [1.0, 42.0, 1.0, 42.0, 42.0]
    with pytest.raises(ValueError):
        failed(None, False)


def test_plan_json_parameters_and_checks():
    assert Plan.from_json(PLAN.to_json()).to_json() == PLAN.to_json()
    assert PLAN.with_params(fp__n_bits=64).outputs[2].kwargs == {"n_bits": 64}
    for bad in ({"nope__x": 1}, {"fp": 1}):
        with pytest.raises(ValueError):
            PLAN.with_params(**bad)
    for steps in ((Step.of("read", "empty_filter"),), (Step.of("a", "os.system"),)):
        with pytest.raises(ValueError):
            Plan(Step.of("read", "smiles"), steps)
    a, p, b = (Plan(Step.of("r", "smiles"), s, (Step.of("s", "smiles"),)).run_one("CCO.C") for s in ((Step.of("x", "largest_fragment"),), (Step.of("x", "largest_fragment"), Step.of("p", "passthrough")), ()))
    assert a == p != b


def test_group_and_time_splits(spark):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate([2, 0, 1, 0, 2, 1])], "row_id long, grp int")
    got = lambda s: [tuple(tuple(sorted(r.row_id for r in s.where(f"split_id = {k} AND role = '{role}'").collect())) for role in ("train", "test")) for k in range(s.select("split_id").distinct().count())]
    assert got(splits.group_addition(rows)) == [((1, 3), (2, 5)), ((1, 2, 3, 5), (0, 4))]
    eight = spark.createDataFrame([(i, i // 2) for i in range(8)], "row_id long, grp int")
    assert got(splits.group_addition(eight, 2)) == [((0, 1, 2, 3), (4, 5)), ((0, 1, 2, 3, 4, 5), (6, 7))]
    assert got(splits.group_addition(eight, 1, 1)) == [((0, 1, 2, 3, 4, 5), (6, 7))]
    ts = spark.createDataFrame([(i, datetime(2020 + i // 2, 1 + i % 2, 1)) for i in range(6)], "row_id long, ts timestamp_ntz")
    assert got(splits.time_threshold(ts, [datetime(2021, 1, 1), datetime(2022, 1, 1)])) == [((0, 1), (2, 3)), ((0, 1, 2, 3), (4, 5))]
    with pytest.raises(ValueError):
        splits.group_addition(rows.where("grp = 0"))


def test_other_splits(spark):
    rows = spark.createDataFrame([(i, i % 7, float(i * i % 101)) for i in range(100)], "row_id long, grp int, y double")
    b = splits.bootstrap(rows, 2).cache()
    assert b.where("role = 'train'").groupBy("split_id").count().orderBy("split_id").collect() == [(0, 100), (1, 100)]
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, splits.bootstrap(rows.repartition(7), 2).collect()))
    for k in range(2):
        t = {r.row_id: r.role for r in b.where(f"split_id = {k}").collect()}
        assert len(t) == 100
    f = splits.percentile_stratified_kfold(rows, 4, 5)
    assert f.where("role = 'test'").count() == 100 and f.count() == 400
    for mode in ("groups", "samples"):
        g = splits.group_shuffle(rows, 3, 0.3, mode).join(rows, "row_id")
        assert g.groupBy("split_id", "grp").agg(F.countDistinct("role").alias("n")).where("n > 1").count() == 0 and g.count() == 300
    assert splits.repetition(rows, 3).count() == 300
    for bad in (lambda: splits.bootstrap(rows, 2, 1.5), lambda: splits.group_shuffle(rows, 2, 0.2, "x"), lambda: splits.percentile_bins(rows.withColumn("y", F.lit(1.0)), 3)):
        with pytest.raises(ValueError):
            bad()


def test_time_helpers():
    d = datetime
    assert T.split_intervals(d(2024, 1, 1), d(2024, 1, 6), 5) == [d(2024, 1, i) for i in (2, 3, 4, 5)]
    assert T.thresholds_for_n_years(d(2024, 1, 1), 2, 4) == [d(2024, 1, 1), d(2023, 10, 1), d(2023, 7, 2), d(2023, 4, 2), d(2023, 1, 1), d(2022, 10, 1), d(2022, 7, 2), d(2022, 4, 2)]
    assert T.thresholds_for_n_years(d(2024, 7, 7), 4, 1, "Y") == [d(y, 1, 1) for y in (2024, 2023, 2022, 2021)]
    assert T.resolve_instant("Q3", d(2024, 5, 5)) == d(2024, 7, 1) and T.resolve_instant("2020-02-03") == d(2020, 2, 3)
    for bad in (lambda: T.thresholds_for_n_years(d(2024, 7, 7), 2, 2, "Y"), lambda: T.split_intervals(d(2024, 1, 2), d(2024, 1, 1), 2), lambda: T.resolve_instant("someday")):
        with pytest.raises(ValueError):
            bad()


THREE = ["000", "100", "110", "101", "010", "011", "001", "111"] * 2


def three_bits(spark):
    return spark.createDataFrame([(i, [k for k, c in enumerate(s) if c == "1"]) for i, s in enumerate(THREE)], "row_id long, bits array<int>")


@pytest.mark.parametrize(("sim", "want"), [
    (0.5, [0, 1, 1, 1, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1, 1, 1]), (0.6, [0, 1, 2, 2, 3, 2, 4, 2, 5, 1, 2, 2, 3, 2, 4, 2]), (1.0, [0, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 6, 7]),
])
def test_components_of_all_three_bit_rows(spark, sim, want):
    got = cluster.connected_component_clustering(three_bits(spark), 1 - sim).orderBy("row_id").collect()
    assert [r.cluster for r in got] == want


def test_pairs_by_either_strategy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, sorted(set(rng.integers(0, 90, rng.integers(0, 12)).tolist()))) for i in range(80)]
    f = spark.createDataFrame(rows, "row_id long, bits array<int>")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.2}
    for strategy in ("prefix", "blocks", "auto"):
        assert {(r.a, r.b) for r in similarity.tanimoto_pairs(f, 0.2, strategy).collect()} == want
    assert {(r.a, r.b) for r in similarity._pairs_by_blocks(f, 0.2, 13).collect()} == want


@pytest.mark.parametrize("below", [cluster.SMALL, 0])
def test_leader_picker(spark, below):
    for distance in (0.0, 0.2, 1 / 3 - 1e-9):
        got = cluster.leader_picker(three_bits(spark), distance, below).orderBy("row_id").collect()
        assert [r.cluster for r in got] == [0, 1, 2, 3, 4, 5, 6, 7] * 2
    rows = [(i, list(range(i, i + 4))) for i in range(12)]
    got = {r.row_id: r.leader for r in cluster.leader_picker(spark.createDataFrame(rows, "row_id long, bits array<int>"), 0.5, below).collect()}
    sets, leaders = [set(b) for _, b in rows], []
    sim = lambda a, b: len(a & b) / len(a | b)
    for i, s in enumerate(sets):
        if not any(1 - sim(s, sets[j]) <= 0.5 for j in leaders):
            leaders.append(i)
    assert got == {i: max(leaders, key=lambda j: (sim(s, sets[j]), -j)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("below", [1000, 0])
def test_components_on_a_long_path(spark, below):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e, one_task_below=below).collect()}
    assert got == dict.fromkeys(range(61), 0) | {100: 100, 101: 100}


def test_similarity(spark):
    a = spark.createDataFrame([(0, [0, 2]), (1, [0, 1]), (9, [])], "row_id long, bits array<int>")
    b = spark.createDataFrame([(0, [0, 2, 3]), (1, [1, 3])], "row_id long, bits array<int>")
    want = {(0, 0): 2 / 3, (0, 1): 0, (1, 0): 1 / 4, (1, 1): 1 / 3, (9, 0): 0, (9, 1): 0}
    for block in (4096, 1):
        assert {(r.q_id, r.t_id): r.value for r in similarity.to_training(a, b, block_rows=block).collect()} == pytest.approx(want)
    assert {(r.q_id, r.t_id): r.value for r in similarity.self_similarity(a).collect()}[(9, 9)] == 0
    f = three_bits(spark).limit(8)
    brute = lambda s, t: len(s & t) / len(s | t) if s | t else 0.0
    sets = {r.row_id: set(r.bits) for r in f.collect()}
    for k, sign in ((1, 1), (3, -1), (None, -1)):
        got = similarity.tanimoto_knn(f, f, k, 64, block_rows=3).orderBy("q_id", "rank").collect()
        for q in sets:
            assert [r.t_id for r in got if r.q_id == q] == sorted(sets, key=lambda t: (-brute(sets[q], sets[t]), sign * t))[: k or 8]
    with pytest.raises(ValueError):
        similarity.tanimoto_pairs(f, 0)
    m = np.array([[1, 0, 1, 0], [1, 1, 0, 0], [0, 0, 0, 0]])
    assert kernels.tanimoto_matrix(m, m).tolist() == [[1, 1 / 3, 0], [1 / 3, 1, 0], [0, 0, 0]]
    mean, std = kernels.gp_predict(m[:2], np.array([1.0, 0.0]), m[:2])
    assert mean == pytest.approx([1, 0], abs=1e-3) and (std < 0.01).all()


def test_attribution_and_grid(spark):
    envs = spark.createDataFrame([(0, 1, [0, 1]), (0, 1, [2]), (0, 5, [0])], "row_id long, bit int, atoms array<int>")
    w = spark.createDataFrame([(0, 1, 1.0), (0, 5, 0.5), (0, 7, 9.0)], "row_id long, bit int, w double")
    assert {r.atom: r.weight for r in kernels.atom_weights(envs, w).collect()} == pytest.approx({0: 0.75, 1: 0.25, 2: 0.5})
    x = spark.createDataFrame([(0, 1, 2.0), (0, 0, 3.0)], "row_id long, x int, w double")
    assert tuple(kernels.present_and_absent(x).first()) == (0, 2.0, 3.0)
    with pytest.raises(ValueError):
        kernels.present_and_absent(x.withColumn("x", F.lit(2)))
    g = kernels.gaussian_grid(spark.createDataFrame([(0, 0.0, 0.0, 2.0)], "row_id long, x double, y double, weight double"), spark.createDataFrame([(0.0, 0.0)], "cx double, cy double"))
    assert g.first().value == 2.0


def test_scores_and_votes(spark):
    d = spark.createDataFrame([(1, 1.0), (0, 0.0), (0, 0.0), (1, 1.0), (0, float("nan")), (0, None)], "t int, p double")
    assert stats.balanced_accuracy(d, "t", "p").first().score == 1.0
    v = spark.createDataFrame([(0, 2), (0, 1), (0, 2), (1, 3), (1, 1)], "row_id long, y int")
    assert {r.row_id: r.y for r in stats.hard_vote(v).collect()} == {0: 2, 1: 1}
    p = spark.createDataFrame([(0, [0.2, 0.8]), (0, [0.9, 0.1])], "row_id long, proba array<double>")
    assert stats.soft_vote(p, ["x", "y"]).first().y == "x"


def test_antitonic_and_checks():
    rng = np.random.default_rng(0)
    p = rng.random((200, 2)).tolist()
    curves = conformal.fit_antitonic(p)
    out = np.array([conformal.apply_antitonic(curves, r) for r in p])
    assert out.sum(1) == pytest.approx(np.ones(200)) and (out >= 0).all()
    assert conformal.pool_adjacent([(1, 3, 1), (2, 1, 1), (3, 4, 1)]) == [(1, 2.0), (2, 2.0), (3, 4.0)]
    for c in (0, 1.5):
        with pytest.raises(ValueError):
            conformal.check_confidence(c)
    with pytest.warns(UserWarning):
        conformal.check_confidence(0.3)
    with pytest.raises(ValueError):
        conformal.nonconformity("custom")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=240) > 0).astype(float)
    rows = [(i, list(map(float, r)), float(t), float(r[0] * 2 + 0.1 * r[1])) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, features array<double>, y double, z double").cache()


def test_models(spark, points):
    make = lambda s: models.rf_classifier(5, s, maxDepth=4)
    train, cal, test = points.where("row_id < 120"), points.where("row_id >= 120 AND row_id < 200"), points.where("row_id >= 200")
    c = models.ConformalClassifier(make(1)).fit(train).calibrate(cal)
    e = c.evaluate(test, 0.9).first()
    assert e.error <= 0.3 and 0 < e.avg_c <= 2
    wide, narrow = (c.predict_set(test, x).select(F.avg(F.size("labels"))).first()[0] for x in (0.95, 0.6))
    assert wide >= narrow
    assert models.CrossConformalClassifier(make, n_folds=2, mondrian=True).fit(train).predict_p(test).count() == 80
    for method in ("sigmoid", "isotonic", "temperature"):
        p = models.Calibrated(make, method, 2, class_weight="balanced" if method == "sigmoid" else None).fit(train).predict_proba(test).join(test, "row_id")
        assert p.select(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("int"))).first()[0] > 0.75
    en = models.Ensemble(make, 3).fit(train)
    assert en.predict_hard(test).count() == 40 and en.predict_soft(test, [0.0, 1.0]).count() == 40
    r = models.ConformalRegressor(models.rf_regressor(5, maxDepth=4), 2).fit(train.withColumn("y", F.col("z"))).calibrate(cal.withColumn("y", F.col("z")))
    iv = conformal.evaluate_intervals(r.predict_int(test, 0.8), test.select("row_id", F.col("z").alias("y"))).first()
    assert iv.error <= 0.45 and iv.eff_mean > 0
    x = models.CrossConformalRegressor(lambda s: models.rf_regressor(5, s, maxDepth=4), 2).fit(train.withColumn("y", F.col("z"))).predict_int(test, 0.8)
    assert x.where("lo < hi").count() == 40
    with pytest.raises(ValueError):
        models.Calibrated(make, "none").fit(train)


def test_forest_baseline(spark):
    d = molecules(spark, ["CCO", "CCN", "CCC", "CCCl", "CCBr", "BAD", "OCC", "NCC"]).withColumn("y", (F.col("row_id") % 2).cast("double"))
    b = models.Baseline(n_trees=5, fill=-1.0, error_handling=True).fit(d)
    got = {r.row_id: r.prediction for r in b.predict(d).collect()}
    assert got[5] == -1.0 and len(got) == 8 and got[0] == got[6] and all(v in (0.0, 1.0) for i, v in got.items() if i != 5)


def test_plan_on_a_stream_equals_batch(spark, tmp_path):
    m = molecules(spark, ["CCO", "abc", "c1ccccc1.C"] * 5)
    m.write.parquet(str(tmp_path / "in.parquet"))
    s = streams.run_available(PLAN.apply(streams.file_stream(spark, str(tmp_path), "in.parquet")).select("row_id", "smiles", "ok"))
    assert sorted(map(tuple, s.collect()), key=str) == sorted(map(tuple, PLAN.apply(m).select("row_id", "smiles", "ok").collect()), key=str)


def test_shapley_values(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [0.0, 0.0, 1.0])], "row_id long, features array<double>")
    score = lambda d: d.select("row_id", (F.get("features", F.lit(0)) * 2 + F.get("features", F.lit(1)) * F.get("features", F.lit(2))).alias("value"))
    got = {r.row_id: r for r in explain.shapley_values(rows, [0.0, 0.0, 0.0], score, 40).collect()}
    assert got[0].prediction == 8 and got[0].expected_value == 0 and sum(got[0].shap) == pytest.approx(8) and got[0].shap[0] == pytest.approx(2)
    assert got[1].shap == pytest.approx([0, 0, 0])
    assert all(r.is_valid for r in explain.valid_explanations(explain.shapley_values(rows, [0.0] * 3, score, 1)).collect())


def test_scaffold_clusters(spark):
    from retort.plans.molecules import scaffold_clustering

    rings, linear = ["Cc1ccccc1", "Cc1cc(Oc2nccc(CCC)c2)ccc1", "c1ccccc1"], ["CC", "CCC", "CCCN"]
    codes = lambda texts, **kw: [r.code for r in scaffold_clustering(molecules(spark, texts), **kw).orderBy("row_id").collect()]
    assert codes([*rings, *linear]) == [1, 0, 1, None, None, None]
    assert codes([*rings, *linear], linear_molecules_strategy="own_cluster") == [1, 0, 1, 2, 2, 2]
    assert codes([*rings, "c1ncccc1", "nonsense"]) == [1, 0, 1, 2, None] and codes([*rings, "c1ncccc1"], make_generic=True) == [1, 0, 1, 1]
    with pytest.raises(ValueError):
        codes(rings, linear_molecules_strategy="drop")
