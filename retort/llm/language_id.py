"""Language identification by cross-parsing entropy.

Per language, labelled text goes into a suffix automaton. A text is cut greedily into the longest phrases that occur in
that language's text; the fewer phrases, the closer the language. The count is normalised to bits a character,
``phrases * log2(training characters) / characters`` (Ziv-Merhav cross entropy), and the least wins.

Texts are lower-cased, and whatever stands between two runs of letters counts as one blank, so symbols and digits
decide nothing. The automaton's transitions are completed: where a state has no edge for a character, the phrase ends there and the
next begins with that character, so every character costs one table look-up and no step is taken back. Tables of all
languages stand in one array, and thousands of text pieces step through it at once in numpy. A text is parsed in pieces
of ``PIECE`` characters, which adds at most one phrase a piece and language and bounds the length of the loop.

Learning uses text and language alone, of at most ``TRAIN_DOCS`` documents a language (first by a hash of their id)
with at most ``DOC_CHARS`` characters from the middle of each and ``TRAIN_CHARS`` in all. With many languages each has an equal share of
``ALL_DOCS`` documents (one at least) and ``ALL_CHARS`` characters: bounds that do not grow with the corpus, and that hold the table
of all automata (two states a character, 122 columns of four bytes) under 650 MB. The ``ALPHABET`` most frequent characters of the training
text have codes; any other ends a phrase. Every whole text is predicted.

Defined results: ``und`` with score 0 for a null text, an empty one or one without letters; equal entropies go to the
language first in order; languages are learned from non-null labels; with nothing to learn from every text is ``und``;
repeated rows are predicted one by one, and learned once; a document without an id is not learned from and not held out; columns beyond those named are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retort.llm.common import map_rows, table

TRAIN_DOCS, DOC_CHARS, TRAIN_CHARS = 200, 1000, 40_000
ALL_DOCS, ALL_CHARS = 12_800, 640_000
PIECE, BATCH_CHARS, ALPHABET = 512, 1 << 20, 120
UND = "und"


def suffix_automaton(codes: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Edges and suffix links of the automaton that accepts every substring."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(edges)
        edges.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return edges, link


@functools.cache
def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """-> the code points of all texts, lower-cased, with one blank for each run of other characters; their numbers by text."""
    points = np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t.lower()) for t in texts], np.int64)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    ends = np.cumsum(sizes)
    first = (ends - sizes)[sizes > 0]
    keep[first] = letter[first]
    before = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, points, 32)[keep], before[ends] - before[ends - sizes]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    chars: str  # code i + 1 stands for chars[i]; 0: none of them
    table: np.ndarray  # [state * width + code] -> next state * width * 2 + 1 if a phrase began
    roots: tuple[int, ...]
    log_n: tuple[float, ...]

    @property
    def width(self) -> int:
        return len(self.chars) + 2  # unknown characters first, padding last


def train(texts: dict[str, str]) -> Model:
    """texts: by language. The ALPHABET most frequent characters have codes of their own."""
    texts = {k: "".join(map(chr, normalise([v])[0])) for k, v in sorted(texts.items())}
    texts = {k: v for k, v in texts.items() if v.strip()}
    count: dict[str, int] = {}
    for t in texts.values():
        for c in t:
            count[c] = count.get(c, 0) + 1
    chars = "".join(sorted(sorted(count, key=lambda c: (-count[c], c))[:ALPHABET]))
    code, width = {c: i + 1 for i, c in enumerate(chars)}, len(chars) + 2
    parts, roots, base = [], [], 0
    for t in texts.values():
        edges, _ = suffix_automaton([code.get(c, 0) for c in t])
        n = len(edges)
        first = np.zeros(width, np.int64)
        first[[c for c in edges[0] if c]] = [s for c, s in edges[0].items() if c]
        rows = np.broadcast_to((first + base) * width * 2 + 1, (n, width)).copy()
        s, c, d = (np.array(x, np.int64) for x in zip(*((s, c, d) for s, e in enumerate(edges) for c, d in e.items() if c)))
        rows[s, c] = (d + base) * width * 2
        rows[0] |= 1  # from the root every character begins a phrase
        rows[:, width - 1] = (np.arange(n) + base) * width * 2  # padding stays
        parts.append(rows.astype(np.int32))
        roots.append(base * width)
        base += n
    if base * width * 2 >= 1 << 31:
        raise ValueError("the training bounds are too large for 32-bit states")
    flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
    return Model(tuple(texts), chars, flat, tuple(roots), tuple(math.log2(max(2, len(t))) for t in texts.values()))


def count_phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """-> phrases, by text and language; characters after normalise(), by text."""
    out, chars = np.zeros((len(texts), len(model.langs)), np.int64), np.zeros(len(texts), np.int64)
    look = np.zeros(0x110000, np.uint8)
    look[[ord(c) for c in model.chars]] = np.arange(1, len(model.chars) + 1)
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (n == 0 or n + len(texts[end]) <= BATCH_CHARS):
            n, end = n + len(texts[end]), end + 1
        points, sizes = normalise(texts[at:end])
        codes, chars[at:end] = look[points], sizes
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(at, end), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(starts, pieces) + nth * PIECE
        length = np.minimum(PIECE, np.repeat(starts + sizes, pieces) - begin)
        order = np.argsort(-length, kind="stable")  # pieces that are over need no more steps
        owner, begin, length = owner[order], begin[order], length[order]
        live = np.searchsorted(-length, -np.arange(PIECE), side="left")
        state = np.repeat(np.array(model.roots, np.int32)[:, None], len(owner), 1)
        phrases = np.zeros(state.shape, np.int32)
        for i in range(int(length[0]) if len(length) else 0):
            k = int(live[i])
            v = model.table[state[:, :k] + codes[begin[:k] + i]]
            phrases[:, :k] += v & 1
            state[:, :k] = v >> 1
        np.add.at(out, owner, phrases.T)
        at = end
    return out, chars


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """-> (language, score 0 to 1, bits a character) of each text."""
    phrases, chars = count_phrases(model, [t or "" for t in texts])
    out = []
    for n_chars, row in zip(chars.tolist(), phrases):
        if not model.langs or not n_chars:
            out.append((UND, 0.0, 0.0))
            continue
        bits = [n * log_n / n_chars for n, log_n in zip(row.tolist(), model.log_n)]
        best, *rest = sorted(range(len(bits)), key=lambda i: (bits[i], i))
        score = 1.0 - bits[best] / bits[rest[0]] if rest else 1.0
        out.append((model.langs[best], min(1.0, max(0.0, score)), bits[best]))
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model:
    """Learn from the labelled rows given; key_col orders the sample and nothing else."""
    key = F.xxhash64(F.col(key_col).cast("string"))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), key.alias("key"), F.col(text_col).alias("text"))
    langs = rows.select("lang").distinct().count()
    docs_each, chars_each = max(1, min(TRAIN_DOCS, ALL_DOCS // max(1, langs))), max(1, min(TRAIN_CHARS, ALL_CHARS // max(1, langs)))
    # a row for each id, so that repeated rows do not take the place of others; the group limit runs before the shuffle
    from_ = F.greatest(F.lit(1), ((F.length("text") - DOC_CHARS) / 2).cast("int"))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("key"))
    ids = rows.select("lang", "key").withColumn("rank", rank).where(F.col("rank") <= docs_each).select(F.col("lang").alias("l"), F.col("key").alias("k")).distinct()
    ids = F.broadcast(ids) if langs <= ALL_DOCS else ids  # then ALL_DOCS rows at most
    picked = rows.join(ids, (F.col("lang") == F.col("l")) & (F.col("key") == F.col("k"))).groupBy("lang", "key").agg(F.min(F.substr("text", from_, F.lit(DOC_CHARS))).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in sorted(picked.select("lang", "key", "text").collect()):
        texts.setdefault(r.lang, []).append(r.text)
    return train({k: "\n".join(dict.fromkeys(v))[:chars_each] for k, v in texts.items()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, lang_pred, score, bits_per_char."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ALL_CHARS and ALPHABET
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, bits = zip(*predict(shared.value, b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_char"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_char double")


def known_documents(docs: DataFrame) -> DataFrame:
    """Those that may be learned from: crc32 of the id as text leaves another remainder than 1."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language can be told; those predicted ``und`` go. All columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([x[0] != UND for x in predict(shared.value, texts)], pa.bool_()))

    return map_rows(docs, run)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(known_documents(docs)))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_char")
