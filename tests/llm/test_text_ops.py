"""Language ID, SimHash, pieces, suffixes, edits, grades and personal data against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from retort.llm import decontaminate, language_id, near_copies, pii, quality_classifier, sentencepiece_lattice, simhash, suffix_dedup

DOCS = "doc_id long, text string, fp string, key string, lang string"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, "x", "y", lang) for i, t in enumerate(texts)], DOCS)


def longest_match_phrases(train, text):
    n = i = 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in train:
            k += 1
        n, i = n + 1, i + max(k, 1)
    return n


def test_automaton_parse_equals_longest_matches():
    rng = random.Random(1)
    for _ in range(50):
        train = {k: "".join(rng.choice("abcd ") for _ in range(80)) + "a" for k in "xy"}
        model = language_id.train(train)
        texts = ["".join(rng.choice("abcdez ") for _ in range(rng.randint(0, 60))) for _ in range(8)]
        clean = ["".join(map(chr, language_id.normalise([t])[0])) for t in texts]
        norm = {k: "".join(map(chr, language_id.normalise([t])[0])) for k, t in train.items()}
        got, n = language_id.count_phrases(model, texts)
        assert got.tolist() == [[longest_match_phrases(norm[k], t) for k in "xy"] for t in clean]
        assert n.tolist() == list(map(len, clean))


def test_language_edge_cases(spark):
    model = language_id.train({"a": "the cat sat on the mat", "b": "ein hund und eine katze", "c": "123"})
    got = language_id.predict(model, [None, "", "12 !?", "the cat", "und eine katze " * 5000])
    assert [g[0] for g in got] == ["und", "und", "und", "a", "b"] and all(0 <= g[1] <= 1 for g in got)
    assert language_id.predict(language_id.train({}), ["abc"])[0][0] == "und"
    assert language_id.identify(spark.createDataFrame([], DOCS), model).count() == 0
    left = language_id.keep_identified(docs(spark, ["the cat", None, "1"]), model)
    assert left.columns == ["doc_id", "text", "fp", "key", "lang"] and [r.doc_id for r in left.collect()] == [0]


def test_language_held_out_accuracy(spark):
    from retort.llm.common import table

    d = "/root/testdata/sf0.001"
    known = {r.doc_id: r.lang for r in table(spark, d, "documents").collect()}
    rows = [r for r in language_id.op2_language_id(spark, d).collect() if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in rows) >= 0.95 * len(rows) > 0


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [None, "", " \t", "One", "Two Words", "A b c", "É A b c d e a b c", "x y z " * 500, "w" * 10_000]:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def test_links_cover_every_pair_within_two_bits(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {0, 1, 3}
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    rows = [(i, simhash._signed(x)) for i, x in enumerate(fps)]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {x: find(i) for i, x in enumerate(fps)}
    for crowd in (64, 3):  # pairs alone; the way for crowded keys too
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = simhash.link_classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
        assert {r.fp % (1 << 64): r.component_id for r in got} == want


def test_representatives_with_copies_nulls_and_extra_columns(spark):
    texts = ["a b c d", "A b c d", "q r s t", None, "", "q r s t"]
    d = docs(spark, texts).union(spark.createDataFrame([(2, "q r s t", "x", "y", "en"), (None, "lone words here now", "x", "y", "en")], DOCS))
    kept = near_copies.keep_representatives(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 2), (False, 3), (True, 0)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def brute_segmentations(p, word, n, own):
    """(score, ids) over all segmentations; own: start to end of the pieces that are free."""
    out = []

    def go(i, s, ids):
        if i == len(word):
            out.append((s, tuple(ids)))
            return
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in p.score:
                s1, k = p.score[word[i:j]]
                go(j, s + (0.0 if own.get(i) == j else s1), [*ids, k])
        if word[i] not in p.score:
            b = [p.byte[x] for x in word[i].encode()]
            go(i + 1, s + (0.0 if own.get(i) == i + 1 else p.byte_score * len(b)), ids + b)

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])[:n]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_lattice.Pieces()


def library_spans(sp, text):
    """Start to end of the library's pieces; byte pieces of one character are one."""
    at, spans, bytes_ = 0, {}, 0
    raised = ("\u2581" + text).replace(" ", "\u2581")
    for i in sp.encode(text):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_ += 1
            if bytes_ == len(raised[at].encode()):
                spans[at], at, bytes_ = at + 1, at + 1, 0
        else:
            spans[at] = at = at + len(piece)
    return {a: b for a, b in zip([0, *spans.values()], spans.values())}


def test_n_best_equals_all_segmentations(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    e, rng = sentencepiece_lattice.Encoder(pieces, 4), random.Random(4)
    texts = ["the cat", "hello a", "\u00d1 x", "a\nbc", "a  b", "x\u00b2.", "\U0001f600 in"]
    for t in texts + ["".join(rng.choice("aeinst \u00e9") for _ in range(rng.randint(1, 9))) for _ in range(40)]:
        want, got = brute_segmentations(pieces, ("\u2581" + t).replace(" ", "\u2581"), 4, library_spans(sp, t)), e.encode(t)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])
        assert got[0][1].tolist() == sp.encode(t) and got[0][0] == 0
        assert len({tuple(i) for _, i in got}) == len(got) and all(e.decode(ids) == t for _, ids in got)


def test_best_segmentation_is_the_librarys(spark, pieces):
    import sentencepiece

    from retort.llm.common import table

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = sentencepiece_lattice.op4_sentencepiece_nbest(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        want = sp.encode(texts[r.doc_id] or "")
        assert r.piece_ids == want and r.n_pieces == len(want) and r.score == 0 and r.round_trip
        assert (r.alt_sha256 is None) == (not r.next_scores) and r.next_scores == sorted(r.next_scores, reverse=True)
    e, rng = sentencepiece_lattice.Encoder(pieces), random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice("ab  \n\tThe1\u00b2\u00e9\u4e2d\u6587\U0001f600_-=x") for _ in range(rng.randint(0, 120)))
        assert e.encode(t)[0][1].tolist() == sp.encode(t)
    run = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    assert e.encode(run)[0][1].tolist() == sp.encode(run)


def unigram_model(scores):
    """A model file, written by hand: pieces with scores, unigram, blanks kept."""
    def field(n, kind, data):
        return bytes([n << 3 | kind]) + (bytes([len(data)]) if kind == 2 else b"") + data

    def piece(p, score, kind):
        return field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind])))

    head = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    return head + b"".join(piece(p, s, 1) for p, s in scores.items()) + field(2, 2, field(3, 0, b"\x01"))


def test_n_best_of_a_unigram_model_is_the_librarys():
    import sentencepiece

    rng = random.Random(6)
    scores = {c: -rng.uniform(5, 7) for c in "abcd\u2581"}
    for _ in range(60):
        p = rng.choice(["", "\u2581"]) + "".join(rng.choice("abcd") for _ in range(rng.randint(2, 4)))
        scores.setdefault(p, -rng.uniform(2, 12))
    model = unigram_model(scores)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    e = sentencepiece_lattice.Encoder(sentencepiece_lattice.Pieces(model), 5)
    for _ in range(60):
        t = " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))
        want = sp.nbest_encode_as_ids(t, 5)
        total = lambda ids: sum(sp.get_score(i) for i in ids)
        got = e.encode(t)
        assert [s for s, _ in got] == pytest.approx([total(w) for w in want], abs=1e-4)
        assert got[0][1].tolist() == sp.encode(t)


def test_round_trips_and_library_decodes(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    e = sentencepiece_lattice.Encoder(pieces, 2, cached=4)
    for t in ["", " ", "  two  ", "line\nfeed\r\n\t", "emoji \U0001f600 é", "x" * 50_000, "日本語 ไทย", "a1b2!?"]:
        ids = e.encode(t)[0][1]
        assert e.decode(ids) == t and (not t or sp.decode(ids.tolist()) == t)


def test_encode_documents(spark):
    got = sentencepiece_lattice.encode_documents(docs(spark, ["the cat", None, ""]), keep=("lang",)).orderBy("doc_id").collect()
    assert [r.n_pieces for r in got][1:] == [0, 0] and all(r.round_trip for r in got) and got[0].lang == "en"
    assert sentencepiece_lattice.encode_documents(spark.createDataFrame([], DOCS)).count() == 0


def brute_kept(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(gone), runs))
    return out


def test_suffix_merge_equals_counting_windows():
    rng = random.Random(5)
    for _ in range(150):
        width, gram, alphabet = rng.choice([6, 8, 12]), rng.choice([2, 3, 4]), rng.choice([b"ab", b"abc", b"abcdefgh", b"a\x00"])
        texts = [bytes(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        texts += [texts[0] + texts[-1][:9]] * rng.randint(0, 2)
        blocks = {}
        for part in range(2):
            w = suffix_dedup.RunWriter(3, width, gram)
            w.add([(hashlib.md5(t).digest(), t) for t in texts[part::2] if len(t) >= width])
            for b, x in w.blocks():
                blocks.setdefault(b, []).append(suffix_dedup.read_block(x))
        found = {}
        for runs in blocks.values():
            for k, lo, hi in suffix_dedup.repeated_windows(runs, width, gram):
                found.setdefault(k, []).append((lo, hi))
        assert [suffix_dedup.cut(t, found.get(hashlib.md5(t).digest(), [])) for t in texts] == brute_kept(texts, width)


def test_many_copies_add_nothing_to_a_run():
    rng = random.Random(1)
    text, other = bytes(rng.choices(b"abcdef", k=2000)), bytes(rng.choices(b"abcdef", k=900))
    sizes = {}
    for copies in (2, 10_000):
        w = suffix_dedup.RunWriter(4)
        for _ in range(copies):
            w.add([(b"k" * 16, text)])
        w.add([(b"o" * 16, other + text[100:400])])
        blocks = list(w.blocks())
        sizes[copies] = sum(len(x) for _, x in blocks)
        found = {}
        for b, x in blocks:
            for k, lo, hi in suffix_dedup.repeated_windows([suffix_dedup.read_block(x)]):
                found.setdefault(k, []).append((lo, hi))
        assert suffix_dedup.cut(text, found[b"k" * 16])[0] == b"" and suffix_dedup.cut(other + text[100:400], found[b"o" * 16])[0] == other
    assert sizes[2] == sizes[10_000]


def test_merge_order_and_prefixes():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 9))) for _ in range(5)]
    order, lcps = suffix_dedup.merge_runs([(r, suffix_dedup.common_prefixes(r, 9).tolist()) for r in runs])
    merged = [runs[r][i] for r, i in order]
    assert merged == sorted(x for r in runs for x in r)
    for a, b, n in zip(merged, merged[1:], lcps[1:]):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_remove_repeats(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgé ") for _ in range(260))
    long = "".join(rng.choice("xyz") for _ in range(100_000))
    texts = ["".join(rng.choice("hijklm") for _ in range(90)) + passage, passage + "tail", None, "", "short", long, "u" * 700, passage[:150], "one copy " * 40, "one copy " * 40]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    for i, (kept, removed, runs) in enumerate(brute_kept([(t or "").encode() for t in texts], 200)):
        assert (got[i].kept, got[i].n_removed, got[i].n_spans) == (kept, removed, runs)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def edits(item, text):
    prev = [0] * (len(text) + 1)
    for i in range(1, len(item) + 1):
        cur = [i]
        for j in range(1, len(text) + 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (item[i - 1] != text[j - 1])))
        prev = cur
    return min(prev)


def test_edit_matches_equal_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        item = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 40)))
        text = list(item)
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(text) + 1)
            text[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        text = "".join(rng.choice("abcd") for _ in range(15)) + "".join(text) + "".join(rng.choice("abcd") for _ in range(15))
        m = decontaminate.Matcher([(1, item)], 0.1)
        want, got = edits(item, text), m.find(text)
        assert bool(got) == (want <= m.errors[0]) and (not got or got[0][1] == want)


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps in the shade of a tall green tree."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "another item that is nowhere to be found here"), (5, item)], "item_id long, text string")
    d = docs(spark, ["start " + item.upper() + " end", item.replace("brown", "br0wn").replace("tall", "tal"), "clean text", None, "", item[:40], "pad " * 30_000 + item])
    for chars in (4_000_000, 60):  # one pass; several
        got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(d, bench, item_chars=chars).collect())
        assert got == [(0, 1, 0), (0, 5, 0), (1, 1, 2), (1, 5, 2), (6, 1, 0), (6, 5, 0)]
        left = decontaminate.drop_contaminated(d, bench, item_chars=chars)
        assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5] and left.columns == d.columns
    assert decontaminate.find_leaks(d, bench.where("item_id = 2")).count() == 0


def test_ordinal_classifier(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, k=rng.randint(30, 200)))
        g = i % 4
        rows.append((i, text + (" nasty1 nasty2" if g == 1 else " ### ***" * 20 if g == 0 else ""), int(g != 0), int(g == 1)))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(d, labels)
    got = {r.doc_id: r for r in quality_classifier.classify(d, model).collect()}
    assert list(model.thresholds) == sorted(model.thresholds)
    share = lambda g: np.mean([got[i].selected for i in range(400) if i % 4 == g])
    assert share(0) < 0.05 and share(1) < 0.05 and share(2) > 0.9 and share(3) > 0.9
    more = quality_classifier.classify(spark.createDataFrame([(1, None), (2, ""), (3, "w1 " * 50_000)], "doc_id long, text string"), model).collect()
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in more)
    none = quality_classifier.fit(d, labels.where("false"))
    assert all(r.selected for r in quality_classifier.classify(d.limit(3), none).collect())


def test_ordinal_fit_is_the_plain_likelihoods_optimum():
    rng = random.Random(12)
    rows = []
    for i in range(120):
        g = i % 3
        b = sorted(rng.sample(range(12), rng.randint(0, 5)) + [20 + (g if rng.random() < 0.7 else rng.randrange(3))])
        rows.append((np.array(b, np.int32), np.array([rng.uniform(0.5, 2) for _ in b], np.float32), g))
    model = quality_classifier.fit_ordinal(rows, rounds=4000, rate=0.02)

    def loss(w, cuts):  # minus the log likelihood, each grade weighed by its root of frequency, and the penalty
        n = Counter(g for *_, g in rows)
        share = {g: n[g] ** -0.5 / sum(m**0.5 for m in n.values()) for g in n}
        out = 0.5e-4 * sum(x * x for x in w.values())
        for b, v, g in rows:
            z = sum(w.get(int(i), 0.0) * float(x) for i, x in zip(b, v))
            below = lambda t: 1 / (1 + math.exp(z - t))
            p = (1.0 if g == 2 else below(cuts[g])) - (0.0 if g == 0 else below(cuts[g - 1]))
            out -= share[g] * math.log(p)
        return out

    w = {i: float(model.weights[i]) for i in [*range(12), 20, 21, 22]}
    best = loss(w, model.thresholds)
    for i in w:
        for d in (-0.05, 0.05):
            assert loss(w | {i: w[i] + d}, model.thresholds) > best - 1e-6
    for k in (0, 1):
        for d in (-0.05, 0.05):
            assert loss(w, [t + d * (j == k) for j, t in enumerate(model.thresholds)]) > best - 1e-6
    assert model.thresholds[0] < model.thresholds[1]


def plain_low_buckets(texts):
    """texts: (set of buckets, grade) -> buckets that point to a lower grade."""
    out = set()
    for b in set().union(*(x for x, _ in texts)):
        seen = sum(b in x for x, _ in texts)
        for k in (0, 1):
            p = sum(g <= k for _, g in texts) / len(texts)
            low = sum(b in x for x, g in texts if g <= k)
            p = min(max(p, 1e-9), 1 - 1e-9)
            z, share = (low - seen * p) / max(seen * p * (1 - p), 1e-9) ** 0.5, (low + p) / (seen + 1)
            if seen >= 5 and z >= 4 and math.log(share / (1 - share)) - math.log(p / (1 - p)) >= 3:
                out.add(b)
    return out


def test_op7_query_equals_a_plain_version(spark):
    from retort.llm.common import table

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
    grade = {r.doc_id: 0 if r.quality == 0 else 1 if r.toxic == 1 else 2 for r in table(spark, d, "labels").collect() if r.doc_id in texts}

    def plain(t):
        words, out = (t or "").split(), Counter()
        for w in set(words):
            f = quality_classifier.word_features(w)
            out[f[0]] += 1.0
            out[f[1]] += 1.0
            out[f[2]] += 1.0 / len(set(words))
        for b in quality_classifier._whole(words, len(set(words))):
            out[b] += 1.0
        return out

    features = {i: plain(t) for i, t in texts.items()}
    fitted = [i for i in grade if not quality_classifier.is_held(i)]
    low = plain_low_buckets([(set(features[i]), grade[i]) for i in fitted])
    model = quality_classifier.fit(table(spark, d, "documents"), table(spark, d, "labels"))
    assert set(np.flatnonzero(model.weights).tolist()) <= low
    rows = [(np.array([b for b in sorted(features[i]) if b in low], np.int32), np.array([features[i][b] for b in sorted(features[i]) if b in low], np.float32), grade[i]) for i in sorted(fitted)]
    again = quality_classifier.fit_ordinal(rows)
    assert model.weights == pytest.approx(again.weights, abs=1e-3) and model.thresholds == pytest.approx(again.thresholds, abs=1e-3)
    got = {r.doc_id: r for r in quality_classifier.op7_quality_classifier(spark, d).collect()}
    assert set(got) == set(texts)
    for i, f in features.items():
        z = sum(float(model.weights[b]) * n for b, n in f.items())
        tails = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert (got[i].z, got[i].expected_grade, got[i].tail_probability) == pytest.approx((z, sum(tails), tails[1]), abs=1e-5)
        assert abs(tails[1] - model.select_at) < 1e-5 or got[i].selected == (tails[1] >= model.select_at)


def test_labels_nulls_repeats_and_long_texts(spark):
    rows = [(1, 0, None), (2, 1, None), (3, 1, 0), (3, 1, 1), (4, None, 1), (None, 1, 0), (5, 1, 0), (5, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {(r.k, r.grade) for r in quality_classifier.labelled(labels, 10).collect()} == {(1, 0), (3, 1), (5, 2)}
    assert quality_classifier.labelled(labels, 2).count() == 2
    # a text of far more distinct words than 20,000 whose last ones tell its grade
    many = " ".join(f"word{i}" for i in range(30_000))
    texts = [(f"a{i}", many + " zzbadzz" if i % 2 else many) for i in range(60)]
    d = spark.createDataFrame(texts + texts[:5], "doc_id string, text string")
    model = quality_classifier.fit(d, spark.createDataFrame([(i, int(not i.endswith(tuple("13579"))), 0) for i, _ in texts], "doc_id string, quality int, toxic int"))
    assert model.weights[quality_classifier.word_features("zzbadzz")[0]] < 0
    got = {r.doc_id: r.selected for r in quality_classifier.classify(d, model).collect()}
    assert all(got[i] == ("zzbadzz" not in t) for i, t in texts)


def test_language_sample_with_many_languages_and_repeats(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng, rows = random.Random(2), []
    for lang in range(80):
        own = rng.sample(letters, 6)
        for k in range(3):
            rows.append((f"{lang}-{k}", "".join(rng.choice(own + [" "]) for _ in range(150)), f"l{lang}", "".join(own)))
    d = spark.createDataFrame(rows + rows[:40] * 3 + [(None, "abc", "l0", ""), ("z", None, "l1", "")], "doc_id string, text string, lang string, x string")
    monkeypatch.setattr(language_id, "ALL_DOCS", 80)
    model = language_id.fit(d)
    assert len(model.langs) == 80  # every language is learned, whatever their number
    own = {r[2]: r[3] for r in rows}
    tests = [(k, "".join(rng.choice(own[k]) for _ in range(200))) for k in own]
    assert sum(p[0] == k for (k, _), p in zip(tests, language_id.predict(model, [t for _, t in tests]))) >= 72
    one = language_id.fit(d.where("lang = 'l0'").dropDuplicates(["doc_id"]))
    assert one.roots == language_id.fit(d.where("lang = 'l0'")).roots and (one.table == language_id.fit(d.where("lang = 'l0'")).table).all()


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1.@-+ ()%2390") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    for t in texts + ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "0000000001.2.3.256", "4111 1111 1111 1111", "é x@y.z", "9" * 5000]:
        assert [x[:3] for x in pii.find_spans(t) if x[1] < 4] == brute_pii(t), t


def test_method_adds_and_redaction(spark):
    t = "IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; my ssn 123-45-6789 but 123-45-6780"
    assert [pii.KINDS[k] for _, k, _, _ in pii.find_spans("bank " + t)] == ["iban", "ssn", "ssn"]
    assert [k for _, k, _, _ in pii.find_spans("number 123-45-6789")] == []
    kinds = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e, _ in pii.find_spans(t) if k > 3]
    assert kinds("pay DE89370400440532013000 ABCD now") == [("iban", "DE89370400440532013000")]
    odd = "ZZ" + next(f"{c:02d}" for c in range(100) if pii.mod97(f"ZZ{c:02d}12345678901234")) + "12345678901234"  # no such country: a word decides
    assert kinds(f"code {odd} here") == [] and kinds(f"bank account {odd} here") == [("iban", odd)]
    card = next(f"GB{c:02d}WEST4111111111111111"[:22] for c in range(100) if pii.mod97(f"GB{c:02d}WEST4111111111111111"[:22]))
    assert ("iban", card) in kinds(f"x {card} y")
    d = spark.createDataFrame([(1, "mail a@b.cd now", 15, "x"), (2, None, None, "x"), (3, "clean", 5, "x"), (4, "1" * 100_000, 7, "x")], "doc_id long, text string, n_chars long, kind string")
    got = pii.redact_documents(d).orderBy("doc_id").collect()
    assert [tuple(r)[:3] for r in got][:3] == [(1, "mail <EMAIL> now", 16), (2, None, None), (3, "clean", 5)] and got[3].n_chars == 7
    assert pii.scan_pii(d).where("doc_id = 2").first().spans == "" and pii.scan_pii(d.limit(0)).count() == 0
