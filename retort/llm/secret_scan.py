r"""Secret scans in DataFrame functions only.

Three base patterns (assignments, access keys, hex runs) and, over candidate strings, a sliding window whose Shannon
entropy is kept by incremental counts: when the window moves, the leaving character's count goes down, the entering
one's goes up, and only their two terms of ``sum c*log2(c)`` change. A candidate is reported as ``entropy`` when its
highest window exceeds the threshold of its character class, unless the allow-list suppresses it or a base span
already covers part of it. Of 4,000 random words of 20 characters, 99 % of those of digits and 27 % of those of one-case letters pass
their thresholds (2.5, 3.8; longer ones have more windows): plain long words reach 3.7, so short runs of letters are told apart in part only.

Spark has no regular-expression function that returns positions, so they are found by splitting: the pieces between
the matches and the matches themselves, in order, give every start by a running sum. Nothing is shuffled.

Defined results: a null text is empty; positions are code points; an empty table gives no rows; repeated rows are
scanned one by one; columns beyond id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.common import let, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs: the least length can stand in the pattern, since a shorter match can only fail as a whole.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
WINDOW = 20
#: Least entropy (bits a character) of a window, by character class of the candidate; the first class that fits counts.
CLASSES = (("digits", "^[0-9]+$", 2.5), ("hex", "^[0-9a-fA-F]+$", 3.0), ("letters", "^([a-z]+|[A-Z]+|[A-Z]?[a-z_-]+)$", 3.8),
           ("upper", "^[A-Z0-9]+$", 3.6), ("mixed", "", 3.8))
#: Placeholders, UUIDs, paths and identifiers made of dashed words.
ALLOW = (r"(?i)example", r"(?i)x{6}", r"(.)\1{7}", r"0123456789|123456789", r"(?i)abcdefgh",
         r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^/?([A-Za-z_-]{1,15}/){2,}[A-Za-z_-]{0,15}$", r"^([A-Za-z]{1,12}[-_=]+){3,}[A-Za-z]{0,12}$")

_SPAN = "array<struct<s:int,e:int,k:int>>"


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (s, e, k) of the pattern's leftmost non-overlapping matches; keep: (text of match, group 2) -> boolean."""
    none = F.array().cast(_SPAN)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep is not None else hits
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.arrays_zip(hits.alias("h"), second.alias("g")), lambda gap, x: F.struct(
        F.length(gap).alias("gap"), F.length(x["h"]).alias("len"), (F.lit(True) if keep is None else keep(x["g"])).alias("ok")))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["len"]).alias("at"),
        F.when(x["ok"], F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["len"]).alias("e"), F.lit(kind).alias("k"))))
        .otherwise(acc["out"]).alias("out"))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(pairs, start, step, lambda acc: acc["out"]).cast(_SPAN)).otherwise(none)


def window_entropy(word: Column, width: int = WINDOW) -> Column:
    """The highest Shannon entropy of any window of so many characters; counts are kept, never taken anew."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)])
    n = len(ALPHABET)
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))  # from 1; 0: some other character
    start = F.struct(F.array_repeat(F.lit(0), n + 1).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def over(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enter, leave = F.get(codes, i), F.coalesce(F.get(codes, i - width), F.lit(-1))
            n_leave = F.coalesce(F.get(acc["n"], leave), F.lit(0))
            n_enter = F.get(acc["n"], enter) - (enter == leave).cast("int")
            total = (acc["sum"] - F.get(terms, n_leave) + F.get(terms, F.greatest(n_leave - 1, F.lit(0)))
                     + F.get(terms, n_enter + 1) - F.get(terms, n_enter))
            counts = F.transform(acc["n"], lambda c, j: c + (j == enter).cast("int") - (j == leave).cast("int"))
            best = F.when(i >= width - 1, F.greatest(acc["best"], F.lit(math.log2(width)) - total / width)).otherwise(acc["best"])
            return F.struct(counts.alias("n"), total.alias("sum"), best.alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["best"])

    return let(F.filter(codes, lambda c: c.isNotNull()), over)


def is_secret_like(word: Column) -> Column:
    """Entropy above the threshold of the word's class, and not on the allow-list."""
    need = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        need = F.when(F.rlike(word, F.lit(pattern)), F.lit(bits)).otherwise(need)
    allowed = F.rlike(word, F.lit("|".join(f"(?:{p})" for p in ALLOW if r"\1" not in p))) | F.rlike(word, F.lit(r"(.)\1{7}"))
    # nested conditions keep the costly part for the few words that need it
    return F.when(need >= math.log2(WINDOW), F.lit(False)).when(allowed, F.lit(False)).otherwise(window_entropy(word) >= need)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, base (array of s, e, k: index into KINDS), extra (entropy spans, no overlap with base)."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = F.array_sort(F.concat(_matches(F.col("t"), ASSIGN, 0, lambda g: F.length(g) >= 8), _matches(F.col("t"), ACCESS, 1), _matches(F.col("t"), HEX, 2)))
    d = d.select("id", "t", F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("b"),
                 _matches(F.col("t"), CANDIDATE, 3).alias("c"))
    free = lambda x: ~F.exists("b", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    extra = F.filter(F.filter("c", free), lambda x: is_secret_like(F.substr(F.col("t"), x["s"] + 1, x["e"] - x["s"])))
    return d.select(F.col("id").alias(id_col), F.array_sort("b").alias("base"),
                    F.transform(extra, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("extra"))


def spans_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, of spans (s, k, e) sorted by start and then by kind as listed."""
    name = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "extra")), KINDS).alias("spans"))
