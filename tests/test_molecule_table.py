from retort.plans.molecules import MOLECULES, READ, molecules, q_molecule_components, q_molecule_knn
from retort.plans.plan import Plan, Step

D = "/root/testdata/sf0.001"


def test_every_readable_row_has_neighbours_and_a_cluster(spark):
    plan = Plan(READ, (), (Step.of("bits", "morgan_bits"),))
    bits = {m[0]: frozenset(plan.run_one(m[0])[0][0]) for m in MOLECULES}
    rows = {r.row_id: bits[r.input] for r in molecules(spark, D).collect() if r.input in bits}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    sim = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    part = dict(first)
    for x in first:
        for y in first:
            if sim(x, y) >= 0.8:
                a, b = part[x], part[y]
                part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
    number = {p: i for i, p in enumerate(sorted(set(part.values())))}
    assert {r.row_id: r.cluster for r in q_molecule_components(spark, D).collect()} == {i: number[part[x]] for i, x in rows.items()}
    want = {}
    for i, x in rows.items():
        for rank, (s, t) in enumerate(sorted(((-sim(x, y), -t) for y, t in first.items()))[:2], 1):
            want[i, rank] = (first[x], -t, round(-s, 6))
    assert {(r.q_id, r["rank"]): (r["class"], r.t_id, r.similarity) for r in q_molecule_knn(spark, D).collect()} == want
