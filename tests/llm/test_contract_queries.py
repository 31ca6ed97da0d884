"""The queries themselves at sf0.001 against plain-Python versions of their contracts, to the last column."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from retort.llm import pii, quality_rules, secret_scan
from retort.llm.common import table
from retort.llm.registry import QUERIES
from tests.llm.test_native_ops import brute_secrets, brute_stats
from tests.llm.test_text_ops import brute_fingerprint, brute_kept, brute_pii

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, D, "documents").collect()}


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def rows(spark, name):
    out = QUERIES[name](spark, D).collect()
    assert len({r.doc_id for r in out}) == len(out)
    return {r.doc_id: r for r in out}


def test_op2(spark, texts):
    got = rows(spark, "op2_language_id")
    langs = {r.lang for r in table(spark, D, "documents").collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred == "und" if not any(c.isalpha() for c in texts[i] or "") else r.lang_pred in langs


def test_op3(spark, texts):
    got = rows(spark, "op3_simhash_near_dedup")
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    part = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and (fp[i] ^ fp[j]).bit_count() <= 2 and part[i] != part[j]:
                a, b = sorted((part[i], part[j]))
                part = {k: a if v == b else v for k, v in part.items()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", part[i]) for i in texts}


def test_op5(spark, texts):
    got = rows(spark, "op5_suffix_dedup")
    data = [(t or "").encode() for t in texts.values()]
    for i, t, (kept, removed, runs) in zip(texts, data, brute_kept(data, 200)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), removed, runs, sha(kept))


def named(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def test_op8(spark, texts):
    got = rows(spark, "op8_pii")
    for i, t in texts.items():
        base, r = brute_pii(t or ""), got[i]
        count = Counter(k for _, k, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in range(4)) and r.base_sha256 == sha(named(base, pii.KINDS))
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert [x for x in spans if x[0] in pii.BASE] == [tuple(x.split(":")) for x in named(base, pii.KINDS).split(",") if x]
        assert spans == sorted(spans, key=lambda x: (int(x[1]), pii.KINDS.index(x[0])))


def test_op9(spark, texts):
    got = rows(spark, "op9_quality_rules")
    docs = table(spark, D, "documents")
    rules = quality_rules.fit_rules(docs, table(spark, D, "labels"))
    for i, t in texts.items():
        n, chars, symbols, dup, repeat = brute_stats(t or "")
        failed, r = n < 50 or 100 * repeat > 50 * n, got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        f = {"n_words": float(n), "mean_word": chars / max(1, n), "symbols_per_word": symbols / max(1, n), "dup_line_share": dup / max(1, len(lines)),
             "repeat_share": repeat / max(1, n), "upper_share": len(re.findall("[A-Z]", t or "")) / max(1, chars)}
        assert r.kept == (not failed and not any(rule.covers(f) for rule in rules))


def plain_grow(data, most):
    """FOIL gain over every cut of every statistic, by counting anew for each."""
    import math

    tests = ()
    while len(tests) < most and any(not b for _, b in data):
        p0, best = sum(b for _, b in data) / len(data), (1e-9, None)
        for f in quality_rules.FEATURES:
            values = sorted({r[f] for r, _ in data})
            for a, b in zip(values, values[1:]):
                for above in (False, True):
                    hit = [bad for r, bad in data if (r[f] > (a + b) / 2) == above]
                    gain = sum(hit) * (math.log2(sum(hit) / len(hit)) - math.log2(p0)) if sum(hit) else 0
                    if gain > best[0]:
                        best = (gain, (f, above, (a + b) / 2))
        if best[1] is None:
            break
        tests += (best[1],)
        data = [(r, bad) for r, bad in data if (r[best[1][0]] > best[1][2]) == best[1][1]]
    return tests


def test_op9_rules_grow_as_plain_gain_says():
    rng = random.Random(3)
    for _ in range(20):
        data = []
        for _ in range(60):
            r = {f: float(rng.randint(0, 5)) for f in quality_rules.FEATURES}
            data.append((r, int(r["n_words"] > 3 and r["mean_word"] < 3 or rng.random() < 0.1)))
        assert quality_rules._grow(data, 4) == plain_grow(data, 4)


def test_op9_takes_string_ids(spark):
    d = spark.createDataFrame([(f"id{i}", " ".join(f"w{j}" for j in range(60)) + " #" * (i % 2 * 40)) for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"id{i}", 1 - i % 2, 0) for i in range(40)], "doc_id string, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(d, quality_rules.fit_rules(d, labels)).collect()}
    assert got == {f"id{i}": i % 2 == 0 for i in range(40)}


def test_op10(spark, texts):
    got = rows(spark, "op10_secret_scan")
    for i, t in texts.items():
        base, r = brute_secrets(t or ""), got[i]
        count = Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(count[k] for k in range(3)) and r.base_sha256 == sha(named(base, secret_scan.KINDS))
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("entropy")] == [x for x in named(base, secret_scan.KINDS).split(",") if x]
