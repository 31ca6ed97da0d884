r"""Quality rules: learned decision lists, in DataFrame functions only.

The statistics of a text come from array functions on its words, without a shuffle. From labelled documents,
sequential covering grows conjunctions of thresholds (FOIL gain), prunes them on rows held back, and stops when no rule
of enough precision is left. The list is emitted as one ordered ``CASE WHEN``, so that Spark compiles the verdict.

The rules are fitted on at most ``FIT_ROWS`` labelled documents, those first by a hash of their id; statistics and
verdicts cover every document.

Defined results: a null text has no words and fails the base rules; words are told apart by 64-bit hashes of three in
a row; without labels, or without both classes among them, the list is empty and only the base rules decide;
labels of one document that disagree count as separate rows; columns beyond id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.common import WS, let, table

FIT_ROWS = 4000
#: Words of a text that fit in the position bits of a packed key; beyond, every window is a candidate.
_PACK_BITS = 20
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share")


def _n_repeat_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more. Exact by 64-bit window hashes; O(n log n) in the words.

    A sort of packed longs (high hash bits, position) leaves the windows with a neighbour of the same high bits; only
    those few are then sorted by their whole hash.
    """

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        mask = F.lit((1 << _PACK_BITS) - 1).cast("long")
        at = lambda v: v.bitwiseAND(mask).cast("int")
        high = lambda v: F.shiftright(v, _PACK_BITS)
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-(1 << _PACK_BITS)).cast("long")).bitwiseOR(i.cast("long"))))
        near = lambda p: F.filter(p, lambda v, i: (high(v) == high(F.get(p, i + 1))) | (high(v) == high(F.get(p, i - 1))))
        few = let(packed, lambda p: F.transform(near(p), lambda v: F.struct(F.get(h, at(v)).alias("h"), at(v).alias("i"))))
        every = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        rows = F.sort_array(F.when(n <= 1 << _PACK_BITS, few).otherwise(every))
        twice = lambda r: F.filter(r, lambda x, i: F.coalesce((x["h"] == F.get(r, i + 1)["h"]) | (x["h"] == F.get(r, i - 1)["h"]), F.lit(False)))
        starts = let(rows, lambda r: F.sort_array(F.transform(twice(r), lambda x: x["i"])))
        covered = lambda s: F.aggregate(
            s, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(h)) == n, 0).otherwise(let(starts, covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, of_hashes))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper (all long)."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    only = lambda chars: F.length(F.regexp_replace("t", chars, "")).cast("long")
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    words = F.filter(F.split("t", WS, -1), lambda w: w != "")
    numbers = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _n_repeat_words(w).cast("long").alias("r")))
    d = d.select(
        "id", numbers.alias("w"), only(WS).alias("word_chars"), only(r"[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        only(r"[^A-Z]+").alias("n_upper"), F.greatest(let(lines, F.size), F.lit(1)).alias("n_lines"))
    return d.select(F.col("id").alias(id_col), F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                    F.col("w.r").alias("n_repeat_words"), "n_upper", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [F.col("n_words").cast("double").alias("n_words"), (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / words).alias("symbols_per_word"),
            (F.col("n_dup_lines") / F.col("n_lines")).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
            (F.col("n_upper") / chars).alias("upper_share")]


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, above, threshold) holds: value > threshold if above, else <= threshold."""

    tests: tuple[tuple[str, bool, float], ...]
    n_rejected: int = 0
    precision: float = 0.0

    def covers(self, row: dict[str, float]) -> bool:
        return all((row[f] > t) == above for f, above, t in self.tests)

    def condition(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.tests:
            out = out & ((F.col(f) > t) if above else (F.col(f) <= t))
        return out


def _grow(rows: list[tuple[dict, int]], most_tests: int) -> tuple:
    tests: tuple = ()
    while len(tests) < most_tests and any(not bad for _, bad in rows):
        p0, n0 = sum(bad for _, bad in rows), len(rows)
        best = (1e-9, None)
        for f in FEATURES:
            ordered = sorted((r[f], bad) for r, bad in rows)
            below = bad_below = 0
            for i, (v, bad) in enumerate(ordered[:-1]):
                below, bad_below = below + 1, bad_below + bad
                if ordered[i + 1][0] == v:
                    continue
                for above, p, n in ((False, bad_below, below), (True, p0 - bad_below, n0 - below)):
                    if p and (gain := p * (math.log2(p / n) - math.log2(p0 / n0))) > best[0]:
                        best = (gain, (f, above, (v + ordered[i + 1][0]) / 2))
        if best[1] is None:
            break
        tests += (best[1],)
        f, above, t = best[1]
        rows = [(r, bad) for r, bad in rows if (r[f] > t) == above]
    return tests


def learn_rules(rows: list[tuple[dict[str, float], int]], most_rules: int = 12, most_tests: int = 4, least_precision: float = 0.97, least_covered: int = 3) -> list[Rule]:
    """Sequential covering over (statistics, 1 if of low quality); every third row prunes."""
    rules: list[Rule] = []
    grow, prune = [x for i, x in enumerate(rows) if i % 3], [x for i, x in enumerate(rows) if i % 3 == 0]
    while len(rules) < most_rules and any(bad for _, bad in grow):
        tests = _grow(grow, most_tests)
        if not tests:
            break

        def worth(tests: tuple, held: list) -> tuple[float, int, int]:
            hit = [bad for r, bad in held if Rule(tests).covers(r)]
            return ((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, len(hit), sum(hit))

        tests = max((tests[:k] for k in range(len(tests), 0, -1)), key=lambda t: (worth(t, prune)[0], -len(t)))
        _, n, p = (x + y for x, y in zip(worth(tests, prune), worth(tests, grow)))
        if n < least_covered or p / n < least_precision:
            break
        rule = Rule(tests, n, p / n)
        rules.append(rule)
        grow, prune = ([x for x in part if not rule.covers(x[0])] for part in (grow, prune))
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """The decision list learned from those of at most fit_rows labelled documents that pass the base rules."""
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("k"), (F.col("quality") == 0).cast("int").alias("bad"))
    some = some.orderBy(F.xxhash64("k"), "k", "bad").limit(fit_rows)  # bounded: this side is broadcast
    known = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("k"))
    stats = text_statistics(known.select(F.struct("k", "bad").alias("doc_id"), "text"))
    # base_failed is applied here: as a filter it would move below the join and take the statistics of every document
    rows = stats.select("doc_id.bad", "doc_id.k", base_failed().alias("failed"), *features()).collect()
    rows = sorted((r.asDict() for r in rows if not r.failed), key=lambda r: (zlib.crc32(str(r["k"]).encode()), str(r["k"]), r["bad"]))
    return learn_rules([(r, r["bad"]) for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list rejects; needs the columns of features()."""
    out = None
    for rule in rules:
        out = (F.when if out is None else out.when)(rule.condition(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    s = text_statistics(docs)
    s = s.select("doc_id", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("n_words").alias("words"), base_failed().alias("base_failed"), *features())
    return s.select("doc_id", F.col("words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & verdict(rules)).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
