"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to ``e = m * ERROR_RATE`` edits. Cut into e + 1 pieces, at least one
piece of it then stands in the text unchanged. One Aho-Corasick automaton finds all pieces of all items in one pass
over a text; around each hit, Myers' bit-parallel distance (the item's characters are the bits of one integer) decides.
Texts and items are compared in lower case with white space runs as one blank.

The automaton is built from at most ``ITEM_CHARS`` characters of items at a time. A larger benchmark takes several
passes, each over another hash class of items, so what is broadcast has a bound and no item is left out.

Defined results: null or empty items match nothing, nor do null or empty texts; items of equal text match alike; a
document and an item give one row, the match of fewest edits (then the first); repeated rows of a document
give repeated rows; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from retort.llm.common import map_rows, table

ERROR_RATE, ITEM_CHARS = 0.05, 4_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers_best(item: str, peq: dict[str, int], text: str, start: int, end: int, most: int) -> tuple[int, int] | None:
    """The least edit distance of item to any substring of text[start:end] that is <= most, and its (first) end."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for at in range(max(0, start), min(len(text), end)):
        eq = peq.get(text[at], 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a match may begin anywhere: no 1 is shifted in
        pv, mv = ((mh << 1) & full) | ~(xv | ph) & full, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """items: (id, text). Find every item in a text within its error budget."""

    def __init__(self, items: list[tuple[int, str | None]], error_rate: float = ERROR_RATE):
        self.items = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if t]
        self.errors = [math.floor(len(t) * error_rate) for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, ((_, t), e) in enumerate(zip(self.items, self.errors)):
            for offset, piece in pieces(t, e):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = None
        if where:
            self.automaton = ahocorasick.Automaton()
            for piece, at in where.items():
                self.automaton.add_word(piece, (len(piece), at))
            self.automaton.make_automaton()
        self.peq: dict[int, dict[str, int]] = {}

    def _peq(self, k: int) -> dict[str, int]:
        if k not in self.peq:
            out: dict[str, int] = {}
            for i, c in enumerate(self.items[k][1]):
                out[c] = out.get(c, 0) | 1 << i
            self.peq[k] = out
        return self.peq[k]

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, edits, end in the normalised text), one for each item found, by item."""
        text = normalise(text)
        if not text or self.automaton is None:
            return []
        hits: dict[int, set[int]] = {}
        for end, (length, at) in self.automaton.iter(text):
            for k, offset in at:
                hits.setdefault(k, set()).add(end + 1 - length - offset)
        out = []
        for k, starts in hits.items():
            (i, item), e = self.items[k], self.errors[k]
            m = len(item)
            exact = next((s for s in sorted(starts) if s >= 0 and text.startswith(item, s)), None)
            if exact is not None:
                out.append((i, 0, exact + m))
                continue
            best, upto, windows = None, -1, []
            for s in sorted(starts):  # overlapping windows are searched as one
                if windows and s - e <= upto:
                    windows[-1][1] = upto = s + m + e
                else:
                    windows.append([s - e, upto := s + m + e])
            for a, b in windows:
                if (found := myers_best(item, self._peq(k), text, a, b, e)) and (best is None or found[0] < best[0]):
                    best = found
            if best:
                out.append((i, *best))
        return sorted(out)


def _parts(benchmark: DataFrame, item_col: str, text_col: str, most_chars: int) -> Iterator[DataFrame]:
    """Hash classes of distinct items, of about most_chars characters at most."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    n = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / most_chars))
    for i in range(n):
        yield items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", error_rate: float = ERROR_RATE, item_chars: int = ITEM_CHARS) -> DataFrame:
    """-> doc_id, item_id, edits, match_end: one row for each document and item within the item's error budget."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for part in _parts(benchmark, item_col, item_text_col, item_chars):
        run = _finder(docs, [(r.item_id, r.text) for r in part.collect()], error_rate, to_arrow_type(benchmark.schema[item_col].dataType))
        found = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits long, match_end long")
        out = found if out is None else out.union(found)
    return out


def _matcher_of(shared, cache: dict) -> Matcher:
    if "m" not in cache:
        cache["m"] = Matcher(*shared.value)
    return cache["m"]


def _finder(docs: DataFrame, items: list, error_rate: float, item_type: pa.DataType):
    shared = docs.sparkSession.sparkContext.broadcast((items, error_rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            rows = [(d, *f) for d, t in zip(b.column(0), b.column(1)) for f in _matcher_of(shared, cache).find(t.as_py())]
            doc, item, edits, end = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([d.as_py() for d in doc], b.schema.field(0).type), pa.array(item, item_type), pa.array(edits, pa.int64()), pa.array(end, pa.int64())],
                ["doc_id", "item_id", "edits", "match_end"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      error_rate: float = ERROR_RATE, item_chars: int = ITEM_CHARS) -> DataFrame:
    """The rows in which no item is found, all columns."""
    for part in _parts(benchmark, item_col, item_text_col, item_chars):
        shared = docs.sparkSession.sparkContext.broadcast(([(r.item_id, r.text) for r in part.collect()], error_rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache: dict = {}
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col))
                yield b.filter(pa.array([not _matcher_of(shared, cache).find(t.as_py()) for t in texts], pa.bool_()))

        docs = map_rows(docs, run)
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
