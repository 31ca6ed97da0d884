"""What must hold of the plans and of small blocks, so that nothing grows with the table on the driver or in one task."""


import math
import random

import pytest
from pyspark.sql import functions as F

from retort.functions import blocks
from retort.operators import cluster, kernels, models, similarity, splits


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_atom_weights_sends_nothing_to_the_driver(spark):
    envs = spark.createDataFrame([(0, 5, [0, 1]), (0, 5, [2]), (0, 7, [1]), (1, 5, [0])], "row_id long, bit long, atoms array<long>")
    weights = spark.createDataFrame([(0, 5, 1.0), (0, 7, 2.0), (1, 5, 3.0), (2, 5, 9.0)], "row_id long, bit long, w double")
    out = kernels.atom_weights(envs, weights)
    assert "Broadcast" not in executed(out)
    assert {(r.row_id, r.atom): r.weight for r in out.collect()} == {(0, 0): 0.25, (0, 1): 2.25, (0, 2): 0.5, (1, 0): 3.0}


NAN = float("nan")
#: Distances of two vectors in plain Python.
BRUTE = {
    "euclidean": math.dist, "sqeuclidean": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)), "manhattan": lambda a, b: sum(abs(x - y) for x, y in zip(a, b)), "chebyshev": lambda a, b: max(abs(x - y) for x, y in zip(a, b)),
    "cosine": lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), "hamming": lambda a, b: sum(x != y for x, y in zip(a, b)) / len(a),
    "jaccard": lambda a, b: 1 - sum(x != 0 and y != 0 for x, y in zip(a, b)) / sum(x != 0 or y != 0 for x, y in zip(a, b)), "canberra": lambda a, b: sum(abs(x - y) / (abs(x) + abs(y)) for x, y in zip(a, b) if x or y),
}


@pytest.mark.parametrize("metric", BRUTE)
def test_named_neighbors_in_blocks(spark, monkeypatch, metric):
    """Small blocks, many ties; a task of two blocks gives its nearest only, never its pairs."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 24 * 5)
    rng = random.Random(1)
    v = [[float(rng.randint(-2, 2)), float(rng.randint(0, 2)), rng.choice((0.5, 1.5))] for _ in range(41)]
    d = spark.createDataFrame([(i, x, f"n{i}") for i, x in enumerate(v)], "row_id long, vector array<float>, name string")
    for radius in (None, 0.75):
        out = similarity.named_neighbors(d.where("row_id % 4 = 0"), d, 3, metric, radius=radius)
        plan = executed(out)
        assert "CartesianProduct" in plan and "MapInArrow" in plan and "HashJoin" not in plan and "MergeJoin" not in plan
        want = {}
        for q in range(0, 41, 4):
            near = sorted((BRUTE[metric](v[q], x), t) for t, x in enumerate(v))
            near = near[:3] if radius is None else [x for x in near if x[0] <= radius]
            want |= {(q, k): (f"n{t}", pytest.approx(e, abs=1e-12)) for k, (e, t) in enumerate(near, 1)}
        got = {(r.q_id, r["rank"]): (r.name, r.distance) for r in out.collect()}
        if metric in ("cosine", "canberra", "euclidean"):  # the last bit may order equal ones
            assert [(k, e) for k, (_, e) in sorted(got.items())] == [(k, e) for k, (_, e) in sorted(want.items())]
        else:
            assert got == want


def test_named_neighbors_of_odd_vectors(spark):
    """Zero vectors are compared like others, NaN is farthest; neither is left out."""
    v = [[0.0, 0.0], [1.0, 0.0], [NAN, 1.0], [3.0, 0.0], [0.0, 4.0]]
    d = spark.createDataFrame([(i, x, f"n{i}") for i, x in enumerate(v)], "row_id long, vector array<double>, name string")
    got = [(r.q_id, r["rank"], r.name) for r in similarity.named_neighbors(d.where("row_id IN (0, 1, 4)"), d, 5, "manhattan").orderBy("q_id", "rank").collect()]
    assert got == [(q, k, f"n{t}") for q, near in ((0, (0, 1, 3, 4, 2)), (1, (1, 0, 3, 4, 2)), (4, (4, 0, 1, 3, 2))) for k, t in enumerate(near, 1)]


def fingerprints(spark, n=83):
    """Two to three words each, a few empty ones, some equal ones."""
    rng = random.Random(2)
    bits = [sorted({rng.choice((0, 1, 2, 3, 63, 64, 65, 127, 140)) for _ in range(rng.randint(0, 7))}) if i % 9 else [] for i in range(n)]
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0
    return bits, sim, spark.createDataFrame(list(enumerate(bits)), "row_id long, bits array<int>")


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 600)
    monkeypatch.setattr(similarity, "_AT_ONCE_BITS", 5)
    monkeypatch.setattr(similarity, "LEAST_ROWS", 4)
    monkeypatch.setattr(similarity, "_BATCH", 3)


def test_self_similarity_is_added_up_without_its_matrix(spark, small_blocks):
    bits, sim, f = fingerprints(spark)
    out = similarity.similarity_totals(f, f, 0.4)
    assert "CartesianProduct" in executed(out)
    want = {i: (pytest.approx(sum(sim(a, b) for b in bits)), sum(sim(a, b) > 0.4 for j, b in enumerate(bits) if j != i)) for i, a in enumerate(bits)}
    assert {r.q_id: (r.total, r.n_near) for r in out.collect()} == want
    other = f.select("row_id", F.expr("transform(bits, b -> b + 1)").alias("bits"))  # the same ids on other rows
    want = {i: sum(sim(a, [y + 1 for y in b]) > 0.4 for j, b in enumerate(bits) if j != i) for i, a in enumerate(bits)}
    assert {r.q_id: r.n_near for r in similarity.similarity_totals(f, other, 0.4).collect()} == want


def test_matrix_repeats_and_broadcasts_nothing(spark, monkeypatch):
    bits, sim, f = fingerprints(spark)
    want = {(i, j): pytest.approx(sim(a, b)) for i, a in enumerate(bits) for j, b in enumerate(bits) if i % 5 == 0}
    for most in (64, 2):  # as words, and as arrays
        monkeypatch.setattr(similarity, "_MOST_WORDS", most)
        out = similarity.to_training(f.where("row_id % 5 = 0"), f, block_rows=10)
        plan = executed(out)
        assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
        assert {(r.q_id, r.t_id): r.value for r in out.collect()} == want


@pytest.mark.parametrize("k", [1, 3, 30, None])
def test_neighbours_of_many_blocks(spark, small_blocks, monkeypatch, k):
    """Few neighbours come from pairs of blocks; many are ranked a query at a time, without a shuffle of the matrix."""
    monkeypatch.setattr(similarity, "MANY", 20)
    bits, sim, f = fingerprints(spark)
    out = similarity.tanimoto_knn(f.where("row_id % 5 < 2"), f, k)
    assert ("Window" in executed(out)) == (k in (1, 3))
    want = {}
    for q in range(len(bits)):
        if q % 5 < 2:
            near = sorted((-sim(bits[q], b), t if k == 1 else -t) for t, b in enumerate(bits))[:k]
            want |= {(q, i): (abs(t), pytest.approx(-s)) for i, (s, t) in enumerate(near, 1)}
    assert {(r.q_id, r["rank"]): (r.t_id, r.similarity) for r in out.collect()} == want


def test_pairs_by_blocks_of_many_words(spark, small_blocks):
    bits, sim, f = fingerprints(spark)
    for t in (0.3, 0.5, 1.0):
        want = {(i, j): pytest.approx(sim(a, b)) for i, a in enumerate(bits) for j, b in enumerate(bits) if i < j and sim(a, b) >= t}
        out = similarity.tanimoto_pairs(f, t, "blocks")
        assert "CartesianProduct" in executed(out)
        assert {(r.a, r.b): r.sim for r in out.collect()} == want


def test_components_of_links_contracted_in_their_task(spark, small_blocks):
    bits, sim, f = fingerprints(spark)
    for t in (0.4, 0.7):
        root = list(range(len(bits)))
        for i, a in enumerate(bits):
            for j, b in enumerate(bits[:i]):
                if sim(a, b) >= t and root[i] != root[j]:
                    lo, hi = sorted((root[i], root[j]))
                    root = [lo if r == hi else r for r in root]
        links = similarity._links_by_blocks(f, t)
        got = {r.node: r.component for r in cluster.connected_components(links).collect()}
        assert {i: got.get(i, i) for i in range(len(bits))} == dict(enumerate(root))
        per_task = links.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("b").alias("rows"))
        assert per_task.where("n <> rows").isEmpty()  # a row leaves a task once, whatever the number of its pairs


@pytest.mark.parametrize("walked", [1, 7, 1000])
def test_leaders_without_pairs(spark, small_blocks, monkeypatch, walked):
    monkeypatch.setattr(cluster, "WALKED", walked)
    monkeypatch.setattr(cluster, "NUMBERED", 5)
    monkeypatch.setattr(cluster, "cheaper", lambda *_: "blocks")
    monkeypatch.setattr(cluster, "tanimoto_pairs", None)
    bits, sim, f = fingerprints(spark, 60)
    leaders, want = [], {}
    near = lambda a, b: 1.0 if not a and not b else sim(a, b)
    for i, a in enumerate(bits):
        if not any(1 - near(a, bits[x]) <= 0.5 for x in leaders):
            leaders.append(i)
    for i, a in enumerate(bits):
        want[i] = i if i in leaders else min((-near(a, bits[x]), x) for x in leaders)[1]
    got = {r.row_id: (r.leader, r.cluster) for r in cluster.leader_picker(f, 0.5).collect()}
    assert got == {i: (x, leaders.index(x)) for i, x in want.items()}
    assert {r.leader for r in cluster.leader_picker(f.where("size(bits) = 0"), 0.5).collect()} == {0}


def test_distinct_ids_of_a_task_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(splits, "COUNTED_ROWS", 50)
    rows = spark.range(100).select(F.col("id").alias("row_id"))
    out = splits._summary(rows, splits.repetition(rows, 4))
    assert "REPARTITION_BY_NUM" in executed(out)
    assert [(r.split_id, r.n, r.n_rows, r.sum_id) for r in out.orderBy("split_id").collect()] == [(k, 100, 100, 4950) for k in range(4)]


def test_folds_and_draws_are_made_once(spark, monkeypatch):
    """Each fold's model reads rows and folds that were written; each member's reads rows that have met their draws."""
    seen = []

    class Line(models.LinearRegression):
        def fit(self, df, params=None):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return super().fit(df, params)

    d = spark.createDataFrame([(i, [float(i % 7)], float(i % 7 + i % 3)) for i in range(60)], "row_id long, features array<double>, y double")
    models.CrossConformalRegressor(lambda _: Line(featuresCol="features", labelCol="y", solver="normal"), n_folds=3, n_groups=3).fit(d)
    assert len(seen) == 3 and all("ExistingRDD" in p and "Join" not in p for p in seen)
    seen.clear()
    models.Ensemble(lambda _: Line(featuresCol="features", labelCol="y", solver="normal"), 3).fit(d)
    assert len(seen) == 3 and all("InMemoryTableScan" in p.split("InMemoryRelation")[0] and "Join" not in p.split("InMemoryRelation")[0] for p in seen)
