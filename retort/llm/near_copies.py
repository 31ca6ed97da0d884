"""Near copies: texts whose sets of five-word shingles have an exact Jaccard similarity of 0.8 or more.

Candidates meet by pigeonring over SimHashes, SimHashes of 1,536 bits in all prune them, and an exact comparison decides:

1. Each distinct text gets ``RINGS`` SimHashes of its set (sets of at most ``FEW`` shingles, whose bits differ more, ``RINGS_FEW``). At similarity
   0.8 two SimHashes differ in 0.1515 of the bits, 9.7 of 64: more than equal keys of one print can cover, so many prints share the work.
2. Each print is a ring of ``SEGMENTS`` segments; each of them starts a chain. Two texts meet there if the first segment is equal (the key) and every
   longer chain, up to the whole ring, keeps its part of ``RING_BUDGET`` bits: l * RING_BUDGET / SEGMENTS for l segments. Prints within three bits
   always have an equal segment. Beyond that it is a matter of chance: at 0.8 a chain holds with 0.8485**16 * 0.967 = 0.069, and a
   pair meets under none of the 192 with the chance 9e-7 (large sets; the worst small ones 7e-6). A key under which more than ``CROWD`` texts lie
   is not filtered: there, all meet.
3. Most that meet in a large group of texts with one long passage in common are less similar. So a text stays under a key only if another there is of
   fitting size and differs from it in at most ``BUDGET`` of the bits that prune (or is too small to be pruned).
   Under each key left the text that meets most others under all its keys is the hub; the greatest hub a text meets is its home. A hub and all at home
   with it are a neighbourhood, and so are the hub and all texts of a key under which homes differ: two texts that meet are in one. No pair is ever a row: neighbourhoods are rows (hub, node).
4. Only the sets of texts with a neighbourhood are made. It is dealt into blocks of bounded rows and shingles, and each task takes two of them.
   It compares exactly: first with the hub, then whatever is not yet linked inside the task. It returns a spanning forest.

Defined results: a null text counts as empty, and two texts without a word are equal; fewer than five words are one shingle; repeated rows
are copies; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.grouped import dealt, sorted_groups, whole_groups
from retort.llm.common import checkpoint, fresh
from retort.llm.simhash import majorities, shingle_hashes
from retort.operators.components import connected_components

#: Words of a shingle; least similarity, as a fraction.
WORDS, SIMILARITY = 5, (4, 5)
#: SimHashes whose rings are searched, for all sets and for those of at most FEW shingles; segments of a ring; bits in which a ring may differ.
RINGS, RINGS_FEW, FEW = 48, 112, 20
SEGMENTS, RING_BUDGET, CROWD = 4, 12, 4096
#: Texts under the keys that one group of rows holds, about.
SLOT_ROWS = 1 << 15
#: SimHashes of a text that prune. Two sets of similarity 0.8 differ in 0.1515 of the bits, in 0.1536 at most from PRUNE_FROM shingles on: 235.9 of 1,536,
#: deviation 14.1. The budget is six deviations more. Sets of fewer than PRUNE_FROM shingles are always compared exactly.
PRINTS, BUDGET, PRUNE_FROM = 24, 321, 64
#: A block of a neighbourhood.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 21
#: Of the filter before texts are fetched; a power of two.
FILTER_BITS = 1 << 24

_WIDTH = 64 // SEGMENTS
_TOP, _BELOW = SIMILARITY


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    return np.unique(shingle_hashes(text, words))


def prints(shingles: np.ndarray, count: int = PRINTS) -> np.ndarray:
    """That many independent SimHashes of the set."""
    return majorities(shingles, count)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64))
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key, text -> id, key, size, rings."""
    for b in batches:
        known: dict[str, tuple] = {}
        found = []
        for key, text in zip(b.column(1).to_pylist(), b.column(2)):
            if key not in known:
                s = shingle_set(text.as_py())
                known[key] = len(s), prints(s, RINGS if len(s) > FEW else RINGS_FEW)
            found.append(known[key])
        columns = [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.int64()), _lists([f[1] for f in found])]
        yield pa.RecordBatch.from_arrays(columns, ["id", "key", "size", "rings"])


def _row_key(key: Column, id: Column) -> Column:
    """One string for a text and an id, never null."""
    return F.md5(F.concat(key, F.coalesce(F.concat(F.lit("="), id.cast("string")), F.lit("-"))))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct text: node (a number of its own), key (MD5), best (its least id, nulls last), size, rings, prints (the first of them)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    signed = rows.mapInArrow(_signed, f"id {kind}, key string, size long, rings array<long>")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("best")
    first = F.first(F.struct("size", "rings")).alias("s")
    texts = checkpoint(signed.groupBy("key").agg(best, first).select("key", "best", "s.*"))
    texts = texts.withColumn("node", F.monotonically_increasing_id())  # fixed, as it numbers the rows of a checkpoint
    return texts.withColumn("prints", F.slice("rings", 1, PRINTS))


def _chains(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """node, rings -> slot (print, segment and the top depth bits of the key), entries (node and print, turned so that the key is lowest)."""
    for b in batches:
        node, rings = b.column(0).to_numpy(), b.column(1)
        starts, flat = rings.offsets.to_numpy(), rings.values.to_numpy().view(np.uint64)
        counts = np.diff(starts)
        for k in range(counts.max(initial=0)):
            has = np.flatnonzero(counts > k)
            print_, slots, cuts, entries = flat[starts[has] + k], [], [0], []
            for i in range(SEGMENTS):
                turned = print_ if not i else (print_ >> np.uint64(i * _WIDTH)) | (print_ << np.uint64(64 - i * _WIDTH))
                slot = (turned & np.uint64((1 << _WIDTH) - 1)) >> np.uint64(_WIDTH - depth)
                order = np.argsort(slot, kind="stable")
                some, first = np.unique(slot[order], return_index=True)
                slots.append(some.astype(np.int64) + ((SEGMENTS * k + i) << _WIDTH))
                cuts += [cuts[-1] + n for n in np.append(first[1:], len(order)).tolist()]
                entries.append(np.stack([node[has][order], turned[order].view(np.int64)], axis=1))
            ends = pa.array(np.array(cuts, np.int32) * 16)
            packed = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, ends.buffers()[1], pa.py_buffer(np.concatenate(entries))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots)), packed], ["slot", "entries"])


def chain_partners(turned: np.ndarray) -> np.ndarray:
    """Prints, turned, in the order of their keys -> whether each has a partner of the same key with which every chain from there keeps its budget."""
    key = turned & np.uint64((1 << _WIDTH) - 1)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    lengths = np.diff(np.append(first, len(key)))
    ends, met = np.repeat(first + lengths, lengths), np.repeat(lengths > CROWD, lengths)
    at, step = np.flatnonzero(~met), 1
    while len(at := at[at + step < ends[at]]):
        differ = turned[at] ^ turned[at + step]
        near = np.flatnonzero(np.bitwise_count(differ) <= RING_BUDGET)
        for n in range(2, SEGMENTS):
            near = near[np.bitwise_count(differ[near] & np.uint64((1 << n * _WIDTH) - 1)) * SEGMENTS <= n * RING_BUDGET]
        met[at[near]] = met[at[near] + step] = True
        step += 1
    return met


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slot, entries -> node, band (segment and key): those that meet another there."""
    for t in sorted_groups(batches, "slot"):
        entries = np.frombuffer(b"".join(t.column("entries").to_pylist()), np.int64).reshape(-1, 2)
        turned, low = entries[:, 1].view(np.uint64), (1 << _WIDTH) - 1
        order = np.argsort(turned & np.uint64(low), kind="stable")
        order = order[chain_partners(turned[order])]
        if len(order):
            band = (entries[order, 1] & low) | (t.column("slot")[0].as_py() & ~low)
            yield pa.RecordBatch.from_arrays([pa.array(entries[order, 0]), pa.array(band)], ["node", "band"])


def ring_keys(signed: DataFrame) -> DataFrame:
    """-> node, band: the keys under which a text meets another by pigeonring."""
    depth = min(_WIDTH, (signed.count() // SLOT_ROWS).bit_length())
    chains = signed.select("node", "rings").mapInArrow(lambda batches: _chains(batches, depth), "slot long, entries binary")
    return checkpoint(dealt(chains, "slot").mapInArrow(_met, "node long, band long"))


def near_partners(group: np.ndarray, size: np.ndarray, block: np.ndarray, across: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Rows in the order of their groups, by size within each -> whether each may be as similar as asked for to another of its group.

    Where across holds, only rows of different blocks are compared. words: a column for each row, a row for each print.
    """
    ends = np.searchsorted(group, group, side="right")
    alive, at, step = np.zeros(len(group), bool), np.arange(len(group)), 1
    while len(at := at[at + step < ends[at]]):
        at = at[size[at] * _BELOW >= size[at + step] * _TOP]  # those after it are larger still
        x = at[~(alive[at] & alive[at + step]) & (~across[at] | (block[at] != block[at + step]))]
        small = x[size[x] < PRUNE_FROM]
        alive[small] = alive[small + step] = True
        x = x[size[x] >= PRUNE_FROM]
        differ = np.zeros(len(x), np.int64)
        for k in range(PRINTS):
            differ += np.bitwise_count(words[k, x] ^ words[k, x + step])
            if k % 8 == 7:
                near = differ <= BUDGET
                x, differ = x[near], differ[near]
        alive[x] = alive[x + step] = True
        step += 1
    return alive


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hub (for a key), i, j, node, at, size, prints -> hub, node: those with a partner under the key."""
    for t in whole_groups(batches, "hub", "i", "j"):
        hub, i, j, size = (t.column(c).to_numpy() for c in ("hub", "i", "j", "size"))
        group = np.cumsum(np.append(True, (hub[1:] != hub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        order = np.lexsort((size, group))
        words = t.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PRINTS)[order].T.copy()
        order = order[near_partners(group[order], size[order], t.column("at").to_numpy()[order], (i != j)[order], words)]
        if len(order):
            yield pa.RecordBatch.from_arrays([pa.array(hub[order]), pa.array(t.column("node").to_numpy()[order])], ["hub", "node"])


def near_keys(signed: DataFrame, keyed: DataFrame) -> DataFrame:
    """keyed: node, band -> those under which the text has a partner of fitting size that differs in few bits."""
    need = keyed.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    own = keyed.join(need, "band").groupBy("node").agg(F.collect_list(F.struct((F.lit(-1) - F.col("band")).alias("hub"), "blocks")).alias("under"))
    own = own.join(signed.select("node", "size", "prints"), "node")  # a row for each text, however many its keys
    rows = own.select("node", "size", "prints", F.explode("under").alias("u")).select("u.hub", "u.blocks", "node", "size", "prints")
    found = _by_blocks(rows).mapInArrow(_near, "hub long, node long").distinct()
    return checkpoint(found.select("node", (F.lit(-1) - F.col("hub")).alias("band")))


def neighbourhoods(signed: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """-> hub, node: distinct; two nodes that meet by pigeonring (or under one of the keys, node and band) share a hub."""
    keyed = ring_keys(signed) if keyed is None else keyed
    met = keyed.groupBy("band").agg(F.count("*").alias("n"))
    own = keyed.join(met, "band").groupBy("node").agg(F.sum("n").alias("met"), F.collect_list("band").alias("bands"))
    keyed = checkpoint(own.select("node", "met", F.explode("bands").alias("band")))
    hubs = keyed.groupBy("band").agg(F.max(F.struct("met", F.negative("node").alias("low"))).alias("top"))
    each = keyed.join(hubs, "band").groupBy("node").agg(F.max("top").alias("home"), F.collect_list(F.struct("band", "top")).alias("at"))
    each = checkpoint(each.select("node", "home", F.explode("at").alias("at")).select("node", F.negative("home.low").alias("home"), "at.band", F.negative("at.top.low").alias("hub")))
    apart = each.groupBy("band").agg(F.min("home").alias("l"), F.max("home").alias("h")).where("l < h").select("band")
    others = each.where("hub <> home").join(apart, "band").select("hub", "node")
    return checkpoint(each.select(F.col("home").alias("hub"), "node").union(others).distinct())


def _large(rows: DataFrame) -> DataFrame:
    """rows: hub, node, size -> hub, blocks of the neighbourhoods that need more than one."""
    need = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    return checkpoint(rows.groupBy("hub").agg(need.cast("int").alias("blocks")).where("blocks > 1"))


def _dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows: hub, node, size, others -> a row for each task (hub, i, j) that takes block i with block j; the hub goes to every task."""
    return _by_blocks(rows.join(large, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))))  # a plain join, which Spark can split


def _by_blocks(rows: DataFrame) -> DataFrame:
    """_dealt of rows that hold the blocks of their hub."""
    rows = rows.withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    mine = F.transform(each, lambda j: F.struct(F.least(F.col("at"), j).alias("i"), F.greatest(F.col("at"), j).alias("j")))
    every = F.flatten(F.transform(each, lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    tasks = rows.withColumn("task", F.explode(F.when(F.col("hub") == F.col("node"), every).otherwise(mine)))
    tasks = tasks.select("hub", "task.i", "task.j", "node", "at", *[c for c in rows.columns if c not in ("hub", "node", "at", "blocks")])
    return dealt(tasks, "hub", "i", "j")


class _Block:
    """The rows of one task in the order of their sizes."""

    def __init__(self, t: pa.Table) -> None:
        t = t.take(np.argsort(t.column("size").to_numpy(), kind="stable")).combine_chunks()
        self.node, self.size, self.at = (t.column(c).to_numpy() for c in ("node", "size", "at"))
        self.hub, self.i, self.j = (t.column(c)[0].as_py() for c in ("hub", "i", "j"))
        self.prints = t.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PRINTS)
        self.ends = np.searchsorted(self.size * _TOP, self.size * _BELOW, side="right")
        self.sets = t.column("set").combine_chunks() if "set" in t.column_names else None

    def may(self, x: int, lo: int, hi: int) -> np.ndarray:
        """Rows of lo:hi, all of fitting size, that may be as similar to x as asked for."""
        near = np.bitwise_count(self.prints[lo:hi] ^ self.prints[x]).sum(axis=1) <= BUDGET
        if self.size[x] < PRUNE_FROM:
            near[:] = True
        elif self.size[lo] < PRUNE_FROM:
            near |= self.size[lo:hi] < PRUNE_FROM
        return lo + np.flatnonzero(near)

    def partners(self, x: int) -> np.ndarray:
        """Rows after x that are compared with it in this task."""
        lo, hi = x + 1, self.ends[x]
        if hi <= lo:
            return np.zeros(0, np.int64)
        found = self.may(x, lo, hi)
        if self.i != self.j and len(found):
            found = found[self.at[found] != self.at[x]]
        return found

    def with_hub(self) -> tuple[int, np.ndarray]:
        h = int(np.flatnonzero(self.node == self.hub)[0]) if (self.node == self.hub).any() else -1
        if h < 0:
            return h, np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.size * _BELOW, self.size[h] * _TOP, side="left"), self.ends[h]
        found = self.may(h, lo, hi)
        return h, found[found != h]


def _forest(g: _Block) -> list[tuple[int, int]]:
    """Links (rows) that join whatever the similarity joins, among the pairs of this task and those with the hub."""
    starts = g.sets.offsets.to_numpy()
    items = g.sets.flatten().to_numpy()
    starts, (values, code) = starts - starts[0], np.unique(items, return_inverse=True)
    marked, root, links = np.zeros(len(values), bool), np.arange(len(g.node)), []

    def link(x: int, others: np.ndarray) -> None:
        others = others[root[others] != root[x]]
        if not len(others):
            return
        own = code[starts[x] : starts[x + 1]]
        marked[own] = True
        for y in others:
            if root[y] == root[x]:
                continue
            both = int(np.count_nonzero(marked[code[starts[y] : starts[y + 1]]]))
            if both * _BELOW >= (len(own) + int(g.size[y]) - both) * _TOP:
                links.append((x, int(y)))
                root[root == root[y]] = root[x]
        marked[own] = False

    link(*g.with_hub())
    for x in range(len(g.node)):
        link(x, g.partners(x))
    return links


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in sorted_groups(batches, "hub", "i", "j"):
        g = _Block(t)
        links = np.array(_forest(g), np.int64).reshape(-1, 2)
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(g.node[links[:, 0]]), pa.array(g.node[links[:, 1]])], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, set."""
    for b in batches:
        sets = pa.array([shingle_set(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), sets], ["node", "set"])


def _one_each(rows: DataFrame, key: str, order: Callable[[], Column]) -> DataFrame:
    """One row for each key, the first in that order; no exchange where the rows lie by key."""
    whole = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != key]), order()).alias("row")
    return rows.groupBy(key).agg(whole).select(key, "row.*")


def _perhaps_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows and wanted: at -> the rows but most of those whose key is not wanted, so that few texts are shuffled to the join that decides.

    A bitmap of FILTER_BITS, as words of 64, is broadcast: FILTER_BITS / 64 rows at most, whatever wanted holds.
    """
    place = F.pmod(F.xxhash64("at"), F.lit(FILTER_BITS))
    word, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, cast(__place & 63 as int))")
    words = wanted.select(place.alias("__place")).select(F.shiftright("__place", 6).alias("__word"), bit.alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    seen = rows.withColumns({"__place": place, "__word": word}).join(F.broadcast(words), "__word").where(F.col("__bits").bitwiseAND(bit) != 0)
    return seen.drop("__place", "__word", "__bits")


def similar_links(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """-> a, b (nodes): links whose components are those of all pairs of similarity SIMILARITY or more."""
    near = neighbourhoods(signed, near_keys(signed, ring_keys(signed)))
    wanted = near.select("node").distinct().join(signed.select("node", "key", "best"), "node")
    wanted = wanted.select("node", _row_key(F.col("key"), F.col("best.id")).alias("at"))
    text = F.coalesce(text_col, F.lit(""))
    texts = docs.select(_row_key(F.md5(text), F.col(id_col)).alias("at"), text.alias("text"))
    texts = _perhaps_in(texts, wanted).join(wanted, "at").dropDuplicates(["at"])
    sets = texts.select("node", "text").mapInArrow(_sets, "node long, set array<long>")
    rows = near.join(signed.select("node", "size", "prints"), "node")
    return checkpoint(_dealt(rows.join(sets, "node"), _large(rows)).mapInArrow(_linked, "a long, b long"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: the least id (nulls last), then the least MD5 of the text. Rows that repeat id and text are copies.

    Of such rows with other columns that differ, the one with the least hash of these stays.
    """
    signed = signatures(docs, id_col, text_col)
    parts = connected_components(similar_links(docs, signed, id_col, text_col))
    parted = signed.join(parts, "node", "left").select(F.coalesce("component", "node").alias("part"), "best", "key")
    kept = parted.groupBy("part").agg(F.min(F.struct("best.none", "best.id", "key")).alias("row"))
    at = fresh(docs, "at")
    kept = kept.select(_row_key(F.col("row.key"), F.col("row.id")).alias(at))
    found = docs.withColumn(at, _row_key(F.md5(F.coalesce(text_col, F.lit(""))), F.col(id_col))).join(kept, at, "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString()]
    return _one_each(found, at, lambda: F.xxhash64(F.lit(0), *plain)).select(*[F.col(f"`{c}`") for c in docs.columns])
