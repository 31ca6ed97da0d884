"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: A-Z lower-cased, words at white space, shingles of three words joined by blanks (fewer words: the whole
sequence), each hashed with XXH64 (seed 42); a bit is set where it is set in over half the hashes. Texts without a
word have fingerprint zero and link like any other.

Candidates: the 64 bits form a ring of ``SEGMENTS``. If two fingerprints differ in at most ``BITS`` bits, some segment
starts a chain whose first l segments differ in at most ``l * BITS / SEGMENTS`` bits together, for every l. For the
first two segments that budget is below one, so both must be equal: a join key of 26 bits. The pair then needs the
longer chains from there, and last the full Hamming distance.

Copies are one class from the start: everything past the fingerprints works on distinct ones. A key under which more
than ``CROWD`` distinct fingerprints meet is not paired: there, each fingerprint stands under itself and under every
variant with one free bit flipped; two within two bits share a variant, and any two that share one are within two bits.
So each variant's members (at most one for each free bit, and one) form a star, with no pair left out and none formed needlessly.

Defined results: a null text has no words; a null id is kept, in the class of its fingerprint, whose component is the
least id there; repeated rows are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.common import checkpoint, table
from retort.operators.components import connected_components

BITS, SEGMENTS, CROWD = 2, 5, 64
_EDGES = [round(64 * i / SEGMENTS) for i in range(SEGMENTS + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_SEGMENT = [((1 << _EDGES[i + 1]) - 1) ^ ((1 << _EDGES[i]) - 1) for i in range(SEGMENTS)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line, at, h = b" ".join(tokens), 0, xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([h(line, 42)], np.uint64)
    starts = []
    for t in tokens:
        starts.append(at)
        at += len(t) + 1
    ends = [s - 1 for s in starts[words:]] + [at - 1]
    return np.array([h(line[s:e], 42) for s, e in zip(starts, ends)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash."""
    return majority(shingle_hashes(text, words))


@np.errstate(over="ignore")
def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes mixed anew for the k-th of independent fingerprints; none at 0."""
    if not k:
        return hashes
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@np.errstate(over="ignore")
def majorities(hashes: np.ndarray, count: int) -> np.ndarray:
    """majority(mixed(hashes, k)) for every k below count, all bits counted side by side.

    Bit b of the words of level w stands for 2**w ones at bit b. Three words of a level are one of it and one of the next (a full adder).
    """
    keys = np.array([0x9E3779B97F4A7C15 * k % (1 << 64) for k in range(count)], np.uint64)
    levels: list[np.ndarray] = []
    for i in range(0, len(hashes), 512):  # bounded memory for very long texts
        part = hashes[i : i + 512]
        add = part[:, None] ^ keys
        add *= np.uint64(0xBF58476D1CE4E5B9)
        add ^= add >> np.uint64(29)
        add *= np.uint64(0x94D049BB133111EB)
        add ^= add >> np.uint64(32)
        add[:, 0] = part
        w = 0
        while len(add):
            if w == len(levels):
                levels.append(add[:0])
            rows, carries = np.concatenate([levels[w], add]), [add[:0]]
            while (n := len(rows) // 3) > 0:
                a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                differ = a ^ b
                carries.append((a & b) | (differ & c))
                rows = np.concatenate([rows[3 * n :], differ ^ c])
            levels[w], add, w = rows, np.concatenate(carries), w + 1
    none = np.zeros(count, np.uint64)
    digits, carry = [], none
    for rows in levels:
        a, b = [*rows, none, none][:2]
        digits.append(a ^ b ^ carry)
        carry = (a & b) | ((a ^ b) & carry)
    digits.append(carry)
    over, level = none.copy(), ~none  # over half, and equal to it so far, from the highest digit
    for w in reversed(range(len(digits))):
        if len(hashes) // 2 >> w & 1:
            level &= digits[w]
        else:
            over |= level & digits[w]
            level &= ~digits[w]
    return over


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """-> doc_id, fp (signed long)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def _mask(*segments: int) -> int:
    return sum(_SEGMENT[s % SEGMENTS] for s in segments)


def _chain_holds(x: Column, y: Column, start: Column) -> Column:
    """Every chain of consecutive segments from start keeps its proportional budget; the whole ring is the Hamming check."""
    differ = x.bitwiseXOR(y)
    out = F.lit(True)
    for n in range(3, SEGMENTS + 1):
        masks = F.array(*[F.lit(_signed(_mask(*range(i, i + n)))) for i in range(SEGMENTS)])
        out = out & (F.bit_count(differ.bitwiseAND(F.get(masks, start))) <= n * BITS // SEGMENTS)
    return out


def near_pairs(fps: DataFrame) -> DataFrame:
    """fps: distinct fp -> x, y: links whose components are those of all pairs within BITS bits."""
    keys = [F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(i, i + 1)))).alias("key")) for i in range(SEGMENTS)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("s")).select("fp", "s.seg", "s.key")
    met = keyed.groupBy("seg", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = checkpoint(keyed.join(met, ["seg", "key"]))
    few, many = keyed.where(F.col("n") <= CROWD), keyed.where(F.col("n") > CROWD)
    l, r = few.alias("l"), few.alias("r")
    same = (F.col("l.seg") == F.col("r.seg")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))
    chain = _chain_holds(F.col("l.fp"), F.col("r.fp"), F.col("l.seg"))
    pairs = l.join(r, same & chain).select(F.col("l.fp").alias("x"), F.col("r.fp").alias("y"))

    # crowded keys: one-bit variants over the bits outside the key
    bits = [[F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64) if not _mask(i, i + 1) >> b & 1]] for i in range(SEGMENTS)]
    free = F.get(F.array(*[F.array(*b) for b in bits]), F.col("seg"))
    variants = many.select("fp", "seg", F.explode(F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("at"))
    stars = variants.groupBy("seg", "at").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("x"), F.explode("fps").alias("y")).where("x <> y")
    return pairs.union(stars)


def link_classes(fps: DataFrame) -> DataFrame:
    """(doc_id, fp) -> fp, part (a fingerprint of the component), component_id: one row for each distinct fingerprint."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links = near_pairs(classes.select("fp"))
    parts = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("part"))
    least = known.groupBy("part").agg(F.min("rep").alias("component_id"))
    return known.join(least, "part").select("fp", "part", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """-> doc_id, fp (signed long), component_id."""
    fps = checkpoint(fingerprints(docs, id_col, text_col, words))
    parts = link_classes(fps).select(F.col("fp").alias("f"), "component_id")
    return fps.join(parts, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
