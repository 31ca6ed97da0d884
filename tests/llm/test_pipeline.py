import random

import corpus_pipeline
from retort.llm import decontaminate, language_id, near_copies, pii, simhash
from retort.llm.common import table

D = "/root/testdata/sf0.001"


def brute_classes(texts):
    """By index the least index that links of five-word Jaccard 0.8 or more reach, over all pairs."""
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    part = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and part[i] != part[j]:
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    return part


def test_stages_keep_what_they_should(spark):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    docs = {r.doc_id: r.text for r in table(spark, D, "documents").collect()}
    fit = language_id.fit(language_id.known_documents(table(spark, D, "documents")))
    left = sorted(i for (i, t), p in zip(docs.items(), language_id.predict(fit, list(docs.values()))) if p[0] != "und")
    kept = [left[p] for p in set(brute_classes([docs[i] for i in left]))]
    m = decontaminate.Matcher([(r.item_id, r.text) for r in table(spark, D, "benchmark").collect()])
    want = {i for i in kept if not m.find(docs[i])}
    assert set(out) == want and all(r.round_trip for r in out.values())
    assert any(pii.redact(docs[i]) != docs[i] for i in want)


def test_empty_table(spark, tmp_path):
    table(spark, D, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, D, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_long_texts_repeats_nulls_and_clashing_names(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, D, "documents").limit(40).collect()]
    long = " ".join(rows[0][1].split()[:50] * 400)
    rows += [rows[3], rows[3], (None, rows[4][1], None, None), (900, None, "en", "s"), (901, long, "en", "s"), (902, "", "en", "s")]
    names = ["at", "a.b", "node", "key", "__key", "hub", "set", "part", "size", "id", "row"]
    d = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, D, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert len(set(ids)) == len(ids) and 901 in ids and not {None, 900, 902} & set(ids)
    bare = corpus_pipeline.stage_encode(spark, d.select("doc_id", "text", "lang"), str(tmp_path))
    assert bare.columns[:2] == ["lang", "doc_id"] and bare.count() == d.count()
    stage = near_copies.keep_representatives(d)
    assert stage.columns == d.columns and stage.where("doc_id = 3").count() <= 1


def some_texts(rng, groups, copies, words):
    texts = ["", None, " \n", "A b", "a  B", "one two three four five six", "one two three four five six"]
    for _ in range(groups):  # copies from near to far, and chains of them
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for changes in [0, *[rng.randint(0, 6) for _ in range(copies)]]:
            words_ = list(base)
            for _ in range(changes):
                words_[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words_))
        texts.append(" ".join(base * 30))  # the same shingles many times over
    return texts


def test_near_dedup_stage_is_five_word_jaccard(spark, monkeypatch):
    rng = random.Random(3)
    texts = some_texts(rng, 4, 25, 120) + some_texts(rng, 3, 25, 30)
    want = set(brute_classes(texts))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows, shingles in ((4096, 1 << 21), (7, 1 << 21), (4096, 500)):  # one block, and many
        monkeypatch.setattr(near_copies, "BLOCK_ROWS", rows)
        monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", shingles)
        assert {r.doc_id for r in near_copies.keep_representatives(d).collect()} == want


def test_simhash_budget_keeps_pairs_of_the_least_similarity():
    rng, over = random.Random(9), 0
    for _ in range(400):
        n = rng.choice([64, 65, 150, 800])
        words = [f"w{rng.randrange(10**7)}" for _ in range(n + n // 4)]  # sets of n and 5/4 n: similarity 0.8
        x, y = near_copies.shingle_set(" ".join(words[:n]), 1), near_copies.shingle_set(" ".join(words), 1)
        over += sum(int(a ^ b).bit_count() for a, b in zip(near_copies.prints(x), near_copies.prints(y))) > near_copies.BUDGET
    assert over == 0


def brute_meet(x, y):
    """Whether, from some of the four segments of 16 bits of two prints, l segments differ in at most 3 l bits, and the first in none."""
    d = x ^ y
    turned = [(d >> 16 * i | d << 64 - 16 * i) & (1 << 64) - 1 for i in range(4)]
    return any(not t & 0xFFFF and all((t & (1 << 16 * n) - 1).bit_count() <= 3 * n for n in (2, 3, 4)) for t in turned)


def test_near_dedup_candidates_meet_by_pigeonring_over_simhashes(spark, monkeypatch):
    texts = some_texts(random.Random(5), 3, 25, 60)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = near_copies.signatures(d, "doc_id", "text")
    rings = {r.node: [x % (1 << 64) for x in r.rings] for r in signed.collect()}
    assert {len(r) for r in rings.values()} == {near_copies.RINGS, near_copies.RINGS_FEW}
    want = {(a, b) for a in rings for b in rings if a < b and any(brute_meet(x, y) for x, y in zip(rings[a], rings[b]))}
    for slots, crowd in ((1 << 15, 4096), (16, 4096), (1 << 15, 3)):  # keys in one group, or many; crowded keys lose none
        monkeypatch.setattr(near_copies, "SLOT_ROWS", slots)
        monkeypatch.setattr(near_copies, "CROWD", crowd)
        groups = {}
        for r in near_copies.neighbourhoods(signed).collect():
            groups.setdefault(r.hub, set()).add(r.node)
        assert all(any(a in g and b in g for g in groups.values()) for a, b in want) and want
        assert crowd < 4096 or set().union(*groups.values()) == {n for pair in want for n in pair}


def test_pigeonring_meets_pairs_of_the_least_similarity():
    rng, lost = random.Random(4), 0
    for n in [4, 8, 12, 16, 20, 64, 400] * 30:
        words = [f"w{rng.randrange(10**7)}" for _ in range(n + n // 4)]  # sets of n and 5/4 n: similarity 0.8
        x, y = (near_copies.shingle_set(" ".join(w), 1) for w in (words[:n], words))
        x, y = (near_copies.prints(s, near_copies.RINGS if len(s) > near_copies.FEW else near_copies.RINGS_FEW).tolist() for s in (x, y))
        lost += not any(brute_meet(a, b) for a, b in zip(x, y))
    assert lost == 0


def test_majorities_count_as_one_print_alone():
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 4, 64, 511, 512, 1500):
        hashes = simhash.shingle_hashes(" ".join(f"w{rng.randrange(10**7)}" for _ in range(n)), 1)
        assert simhash.majorities(hashes, 20).tolist() == [simhash.majority(simhash.mixed(hashes, k)) for k in range(20)]


def test_near_dedup_rows_do_not_grow_with_groups_of_less_similar_texts(spark, monkeypatch):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = words(100)
    texts = [" ".join(passage + words(60)) for _ in range(300)]  # 96 of 216 shingles in common
    near = [" ".join([*texts[i].split()[:-3], *words(3)]) for i in range(0, 60, 3)]
    d = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    rows, large = [], near_copies._large
    monkeypatch.setattr(near_copies, "_large", lambda df: rows.append(df.count()) or large(df))
    for block in (4096, 7):  # one block, and many
        monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
        assert {r.doc_id for r in near_copies.keep_representatives(d).collect()} == set(brute_classes(texts + near)) == set(range(300))
    assert rows and max(rows) <= 200  # 6,958 before keys were pruned


def test_near_keys_keep_all_similar_pairs_that_meet(spark, monkeypatch):
    texts = some_texts(random.Random(8), 3, 25, 90) + some_texts(random.Random(2), 2, 25, 30)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = near_copies.signatures(d, "doc_id", "text")
    keyed = near_copies.ring_keys(signed)
    of = {r.best.id: r.node for r in signed.collect()}
    sets = {node: set(near_copies.shingle_set(texts[i]).tolist()) for i, node in of.items()}
    met = {}
    for r in keyed.collect():
        met.setdefault(r.band, set()).add(r.node)
    similar = lambda x, y: 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])
    want = {(band, x) for band, g in met.items() for x in g if any(x != y and similar(x, y) for y in g)}
    for block in (4096, 3):
        monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
        got = [(r.band, r.node) for r in near_copies.near_keys(signed, keyed).collect()]
        assert len(set(got)) == len(got) and want <= set(got) <= {(band, x) for band, g in met.items() for x in g}
