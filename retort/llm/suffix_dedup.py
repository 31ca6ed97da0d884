"""Removal of repeated 200-byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if some ``WIDTH``-byte string over it starts at another place too. Sorting every suffix would move each byte up to
``WIDTH`` times, so suffixes are sorted where it can matter only:

1. *Anchors.* Every window of WIDTH bytes has a minimizer: the position of the least hash among its ``GRAM``-byte
   substrings, the first of equals. It depends on the window's bytes alone, so equal windows have it at the same offset. Consecutive
   windows of one minimizer form a run; a text of n bytes has about n / 91 runs. Per run, the suffix at the minimizer
   (cut where the run's last window ends) is sorted, and what stands before it, read backwards, goes along.
2. *Exchange.* A task takes at most two copies of a text in each run, sorts its suffixes, front-codes each run (length of the prefix shared with the one before, and the
   rest), collapses equal ones, and sends the runs by a hash of the minimizer's gram, so that equal windows meet.
3. *Merge.* A loser tree whose nodes remember the length of the common prefix with the last winner merges the sorted
   runs: unequal lengths decide without looking at a byte; equal ones compare from there on. No known prefix is read again.
4. *Windows.* With the common prefixes of neighbours in the merged order, and those of the backward parts in theirs, the
   windows at offset o of two anchors are equal when both lie in one group of depth WIDTH - o forwards and of depth o
   backwards. Groups of two places or more are repeats: exact, byte by byte, without a pair of places ever being formed.

What goes back is (text hash, from, to), so copies of a whole text share one answer, which joins the texts by that hash; the
join is one that Spark splits where a text has very many copies.

Defined results: a null text is empty; ids may be null or repeated, each row is a text of its own; texts under WIDTH bytes
keep all; surrogates cannot occur in a Spark string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.common import buckets_for, checkpoint, table

WIDTH, GRAM = 200, 20
#: Bytes of text whose suffixes a task sorts at a time; of input by bucket of the exchange; that are hashed at a time.
RUN_BYTES, BUCKET_BYTES, CHUNK_BYTES = 6 << 20, 2 << 20, 1 << 19
LEVEL = 7  # of compression, of runs and of the texts that meet their answers
_POS_BITS = 24  # positions inside a chunk; a text beyond that is cut into overlapping chunks


@np.errstate(over="ignore")
def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every gram-byte substring, by doubling (numpy wraps around)."""
    power, size, part = np.uint64(0x9E3779B97F4A7C15), 1, buf.astype(np.uint64) + np.uint64(1)
    out, have = None, 0  # of the lowest binary digits of gram so far
    while size <= gram:
        if gram & size:
            out = part if out is None else part[: max(0, len(part) - have)] * low + out[size:][: max(0, len(part) - have)]
            low, have = power if have == 0 else low * power, have + size
        if len(part) > size:
            part = part[:-size] * power + part[size:]
        else:
            part = part[:0]
        power, size = power * power, size * 2
    out = out[: max(0, len(buf) - gram + 1)]
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def minimizer_runs(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the texts at starts: (index of the text, first window, last window, minimizer, hash of its gram), by run; positions in buf."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    n = len(buf) - width + 1
    if n <= 0 or not (sizes >= width).any():
        return none
    h = gram_hashes(buf, gram)
    low = np.uint64((1 << _POS_BITS) - 1)
    x = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, have = width - gram + 1, 1
    least = x
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: n], least[span - have : span - have + n])
    at = (least[:n] & low).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    long = sizes >= width
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, starts[long] + sizes[long] - width + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    owner = np.searchsorted(starts[long], windows, side="right") - 1
    m = at[windows]
    new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([new[1:], [len(windows)]]) - 1
    return np.flatnonzero(long)[owner[new]], windows[new], windows[last], m[new], h[m[new]]


def common_prefixes(strings: list[bytes], most: int) -> np.ndarray:
    """Length of the prefix each string (in order) shares with the one before; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    for i in range(0, len(strings), 1 << 14):
        part = strings[max(0, i - 1) : i + (1 << 14)]
        if len(part) < 2:
            continue
        grid = np.array(part, f"S{most}").view(np.uint8).reshape(len(part), most)
        differ = grid[1:] != grid[:-1]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        lcp = np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))
        out[i + (i == 0) : i + (i == 0) + len(lcp)] = lcp
    return out


class RunWriter:
    """Collects the suffixes of texts and gives sorted, front-coded runs by bucket."""

    def __init__(self, buckets: int, width: int = WIDTH, gram: int = GRAM):
        self.buckets, self.width, self.gram = buckets, width, gram
        self.clear()

    def clear(self) -> None:
        self.items: dict[tuple[bytes, bytes], list[int]] = {}
        self.hashes: list[bytes] = []
        self.copies: dict[bytes, int] = {}
        self.size = 0

    def add(self, texts: list[tuple[bytes, bytes]]) -> None:
        """(hash of the text, text), the texts together of about CHUNK_BYTES at most unless there is one alone."""
        step, some = (1 << _POS_BITS) - self.width, []
        for key, text in texts:  # a third copy in one run says nothing that two do not
            self.copies[key] = self.copies.get(key, 0) + 1
            if self.copies[key] <= 2:
                some.append((key, text))
            else:
                self.size += len(text)
        texts = some
        for key, text in texts:
            if len(text) > 1 << _POS_BITS:  # overlapping chunks: every window lies in one
                for cut in range(0, len(text) - self.width + 1, step):
                    self._add([(key, text[cut : cut + step + self.width - 1])], cut)
        self._add([(k, t) for k, t in texts if len(t) <= 1 << _POS_BITS], 0)

    def _add(self, texts: list[tuple[bytes, bytes]], shift: int) -> None:
        if not texts:
            return
        whole = b"".join(t for _, t in texts)
        sizes = np.array([len(t) for _, t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        owner, first, last, anchor, h = minimizer_runs(np.frombuffer(whole, np.uint8), starts, sizes, self.width, self.gram)
        bucket = (h >> np.uint64(20)) % np.uint64(self.buckets)
        base = len(self.hashes)
        self.hashes += [k for k, _ in texts]
        self.size += len(whole)
        rel, items, width = first - starts[owner] + shift, self.items, self.width
        for o, a, b, m, r, q in zip(owner.tolist(), first.tolist(), last.tolist(), anchor.tolist(), rel.tolist(), bucket.tolist()):
            key = (q.to_bytes(4, "big") + whole[m : b + width], whole[a:m])
            got = items.get(key)
            if got is None:
                items[key] = [base + o, r]
            else:
                got += (base + o, r)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        if not self.items:
            return
        order = sorted(self.items)
        at, pack = 0, zstandard.ZstdCompressor(level=LEVEL).compress
        while at < len(order):
            head, end = order[at][0][:4], at
            while end < len(order) and order[end][0][:4] == head:
                end += 1
            yield int.from_bytes(head, "big"), pack(self._block(order[at:end]))
            at = end
        self.clear()

    def _block(self, keys: list[tuple[bytes, bytes]]) -> bytes:
        forward = [r[4:] for r, _ in keys]
        back = [b for _, b in keys]
        lcp = common_prefixes(forward, self.width)
        places = [self.items[k] for k in keys]
        flat = np.array([x for p in places for x in p], np.int64).reshape(-1, 2)
        used, local = np.unique(flat[:, 0], return_inverse=True)
        tails = b"".join([r[n:] for r, n in zip(forward, lcp.tolist())])
        parts = [
            lcp.astype(np.uint8).tobytes(), np.array([len(r) for r in forward], np.uint8).tobytes(), np.array([len(b) for b in back], np.uint8).tobytes(),
            np.array([len(p) // 2 for p in places], np.uint32).tobytes(), local.astype(np.uint32).tobytes(), flat[:, 1].astype(np.int64).tobytes(),
            b"".join([self.hashes[i] for i in used]), tails, b"".join(back),
        ]
        return np.array([len(keys), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def read_block(data: bytes) -> dict:
    """Undo _block: forward suffixes in order, their common prefixes, backward parts, places."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, *sizes = np.frombuffer(raw, np.int64, 10).tolist()
    at, parts = 80, []
    for s in sizes:
        parts.append(raw[at : at + s])
        at += s
    lcp = np.frombuffer(parts[0], np.uint8).tolist()
    out, prev, t = [], b"", 0
    for k, size in zip(lcp, np.frombuffer(parts[1], np.uint8).tolist()):
        prev = prev[:k] + parts[7][t : t + size - k]
        t += size - k
        out.append(prev)
    ends = np.cumsum(np.frombuffer(parts[2], np.uint8).astype(np.int64)).tolist()
    back = [parts[8][a:b] for a, b in zip([0, *ends], ends)]
    count = np.frombuffer(parts[3], np.uint32).astype(np.int64)
    return {"s": out, "lcp": lcp, "back": back, "count": count, "first": np.cumsum(count) - count,
            "text": np.frombuffer(parts[4], np.uint32), "at": np.frombuffer(parts[5], np.int64), "hash": parts[6]}


def _extend(a: bytes, b: bytes, known: int) -> int:
    """The common prefix of a and b, of which so much is known."""
    n = min(len(a), len(b))
    while known + 16 <= n and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (strings, common prefixes in the run) by a loser tree that knows common prefixes.

    -> (run, index) in order, and each one's common prefix with the one before.
    """
    k = 1
    while k < len(runs):
        k *= 2
    none = len(runs)
    where = [0] * (none + 1)
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None]
    shared = [0] * (none + 1)  # with the last winner
    tree = [none] * k  # losers; tree[0]: the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser learns its common prefix with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = _extend(x, y, p)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k if node - k < none else none
        winner, loser = play(build(2 * node), build(2 * node + 1))
        tree[node] = loser
        return winner

    winner = build(1) if none else none
    order: list[tuple[int, int]] = []
    lcps: list[int] = []
    while heads[winner] is not None:
        i = where[winner]
        order.append((winner, i))
        lcps.append(shared[winner])
        strings, known = runs[winner]
        i += 1
        where[winner] = i
        if i < len(strings):
            heads[winner], shared[winner] = strings[i], known[i]
        else:
            heads[winner] = None
        node = (winner + k) >> 1
        while node:
            other = tree[node]
            y = heads[other]
            if y is not None:
                x = heads[winner]
                p, q = shared[winner], shared[other]
                if x is None or p < q:
                    tree[node], winner = winner, other
                elif p == q:
                    n = _extend(x, y, p)
                    if n == len(x) or (n < len(y) and x[n] < y[n]):
                        shared[other] = n
                    else:
                        shared[winner] = n
                        tree[node], winner = winner, other
            node >>= 1
    return order, lcps


def repeated_windows(blocks: list[dict], width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[bytes, int, int]]:
    """(text hash, first byte, end) of stretches whose windows all occur elsewhere. Stretches may repeat and overlap."""
    order, lcps = merge_runs([(b["s"], b["lcp"]) for b in blocks])
    n = len(order)
    if not n:
        return
    lcp = np.array(lcps + [0], np.int64)
    weight = np.array([blocks[r]["count"][i] for r, i in order], np.int64)
    size = np.array([len(blocks[r]["s"][i]) for r, i in order], np.int64)
    most = np.array([len(blocks[r]["back"][i]) for r, i in order], np.int64)  # the greatest offset of a window's anchor
    least = width - size  # the least
    near = np.maximum(lcp[:-1], lcp[1:])
    some = np.flatnonzero((weight > 1) | (near >= width - most))  # the rest have no equal at any offset
    if not len(some):
        return
    back = [blocks[r]["back"][i][::-1] for r, i in (order[j] for j in some.tolist())]
    by_back = sorted(range(len(some)), key=back.__getitem__)
    back_lcp = common_prefixes([back[j] for j in by_back], width)
    by_back = np.array(by_back)
    w, lo, hi = weight[some], least[some], most[some]
    repeated = np.zeros((len(some), width), bool)
    forward, backward = lcp[:-1], np.zeros(len(some), np.int64)
    for o in range(int(lo.min()), int(hi.max()) + 1):
        here = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(here):
            continue
        group = np.cumsum(forward < width - o)[some[here]]
        backward[by_back] = np.cumsum(back_lcp < o)
        both = group * (len(some) + 1) + backward[here]
        rank = np.argsort(both, kind="stable")
        ordered = both[rank]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.add.reduceat(w[here][rank], edge)
        repeated[here[rank], o] = np.repeat(total > 1, np.diff(np.concatenate([edge, [len(rank)]])))
    for j in np.flatnonzero(repeated.any(axis=1)).tolist():
        r, i = order[some[j]]
        b = blocks[r]
        flags = np.concatenate([[False], repeated[j, lo[j] : hi[j] + 1][::-1], [False]])  # by window, from the run's first
        edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
        f = b["first"][i]
        for t, at in zip(b["text"][f : f + b["count"][i]].tolist(), b["at"][f : f + b["count"][i]].tolist()):
            for x, y in zip(edges[::2], edges[1::2]):
                yield b["hash"][16 * t : 16 * t + 16], at + x, at + y - 1 + width


def repeated_stretches(texts: DataFrame, buckets: int, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key binary(16), data binary) -> key, lo, hi."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = RunWriter(buckets, width, gram)
        names = ["bucket", "block"]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*writer.blocks())) or ([], []), (pa.int32(), pa.binary()))], names)
        for b in batches:
            part, size = [], 0
            for key, data in zip(b.column(0), b.column(1)):
                text = data.as_py() or b""
                if len(text) >= width:
                    part.append((key.as_py(), text))
                    size += len(text)
                if size >= CHUNK_BYTES:
                    writer.add(part)
                    part, size = [], 0
                    if writer.size >= RUN_BYTES:
                        yield out()
            writer.add(part)
            if writer.size >= RUN_BYTES:
                yield out()
        yield out()

    def merge(group: pa.Table) -> pa.Table:
        blocks = [read_block(x.as_py()) for x in group.column("block")]
        rows = sorted(set(repeated_windows(blocks, width, gram)))
        key, lo, hi = zip(*rows) if rows else ((), (), ())
        return pa.table([pa.array(key, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["key", "lo", "hi"])

    blocks = texts.mapInArrow(write, "bucket int, block binary")
    return blocks.groupBy("bucket").applyInArrow(merge, "key binary, lo long, hi long")


def cut(text: bytes, stretches: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes kept, bytes removed, maximal removed runs)."""
    kept, spans, end = [], 0, 0
    for lo, hi in sorted(stretches):
        if not spans or lo > end:
            kept.append(text[end:lo])
            spans, end = spans + 1, hi
        else:
            end = max(end, hi)
    left = b"".join([*kept, text[end:]])
    return left, len(text) - len(left), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """-> doc_id, kept (binary), n_bytes, n_removed, n_spans."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(data)).alias("key"), data.alias("data"))
    found = repeated_stretches(rows.select("key", "data"), buckets or buckets_for(docs, BUCKET_BYTES), width, gram)
    # of a text at most one stretch a run and task: its length bounds the list, whatever its number of copies
    found = found.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("lo", "hi")).alias("cut"))
    # written, so that the join below has a shuffle of its own on both sides: Spark can then split a text of very many copies
    found = checkpoint(found)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = [unpack(d.as_py()) for d in b.column(1)]
            done = [cut(d, [(x["lo"], x["hi"]) for x in s.as_py() or ()]) for d, s in zip(texts, b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([k for k, _, _ in done], pa.binary()), pa.array([len(d) for d in texts], pa.int64()),
                 pa.array([n for _, n, _ in done], pa.int64()), pa.array([s for *_, s in done], pa.int64())],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(d.as_py()) for d in b.column(2)], pa.binary())], ["doc_id", "key", "data"])

    packed = rows.mapInArrow(squeeze, f"doc_id {kind}, key binary, data binary")
    both = packed.join(found, F.col("key") == F.col("k"), "left").select("doc_id", "data", "cut")
    return both.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


#: The contract itself: every window is a string (two hex digits a byte), counted whole. For small tables only.
OP5_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT k, unnest(range(0, length(h) // 2 - {WIDTH - 1})) AS pos FROM docs WHERE length(h) >= {2 * WIDTH}),
hashed AS (SELECT w.k, w.pos, md5(substr(d.h, 2 * w.pos + 1, {2 * WIDTH})) AS m FROM windows w JOIN docs d USING (k)),
twice AS (SELECT m FROM hashed GROUP BY m HAVING count(*) > 1),
starts AS (SELECT k, pos, lag(pos) OVER (PARTITION BY k ORDER BY pos) AS prev FROM hashed SEMI JOIN twice USING (m)),
islands AS (SELECT k, pos, sum(CASE WHEN prev IS NULL OR pos > prev + {WIDTH} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS i FROM starts),
gone AS (SELECT k, i, min(pos) AS lo, max(pos) + {WIDTH} AS hi FROM islands GROUP BY k, i),
gaps AS (SELECT k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY lo), 0) AS since FROM gone),
cut AS (SELECT g.k, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS upto,
               string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head FROM gaps g JOIN docs d USING (k) GROUP BY g.k)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.k IS NULL THEN h ELSE head || substr(h, 2 * upto + 1) END)) AS kept_sha256
FROM docs d LEFT JOIN cut c USING (k)
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
