"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

Forward: Viterbi gives every position the best (and, to weigh words against each other, the second best) score of the text before it. Backward: A* from the end, whose heuristic
is that very score, hence exact: segmentations leave the queue in order of their whole score, and nothing is
expanded that is not part of one of the N best (or ties with them).

No piece of the model crosses from letters to other characters or back, from either into a blank, or holds a line feed,
which is checked when it is loaded, so the lattice of a text is a chain of the lattices of its words. Words are solved once
a worker (a bounded table, of which the less used part goes when it is full) and the N best of the chain come from the least losses of its words by one
more best-first search.

Scores: a unigram model's own. A BPE model has no additive scores: its own segmentation comes from merging in the order of ranks. Here a
segmentation scores the pieces by which it departs from that one, each with ``-ln(rank + 2)``, Zipf's law for a piece of that rank, less
``DEPART``; pieces of the model's own segmentation are free. So the best path is the model's own, score 0, and the N best follow it by the
cost of their departures. Characters without a piece fall back to their UTF-8 byte pieces.
Decoding joins the pieces and turns blanks back; encoding then decoding returns every text exactly, but that the model
itself cannot tell its blank (U+2581) in a text from a space.

Defined results: a null text encodes like an empty one, to no piece; of equal scores the first found by the fixed
search order; repeated rows are encoded one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from retort.llm.common import table

MODEL = os.environ.get("RETORT_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
N_BEST, CACHED_WORDS = 3, 400_000
#: What a piece outside a BPE model's own segmentation costs beside its own score.
DEPART = 1.0
BLANK = "\u2581"
#: Blanks with the letters, or with the other characters, that follow; the boundaries that no piece crosses.
_RAISED = "\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"  # digits that the expression would count as letters
_CHUNK = re.compile(rf" *[^\W\d_{_RAISED}]+| *(?:[^\w \n]|[\d_{_RAISED}])+| +|\n")


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Pieces:
    """The vocabulary of a model file: scores of normal pieces, byte pieces, and pieces by id."""

    def __init__(self, model: str | bytes = MODEL):
        sp = sentencepiece.SentencePieceProcessor(**({"model_proto": model} if isinstance(model, bytes) else {"model_file": model}))
        n = sp.vocab_size()
        scores = [sp.get_score(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranks = all(scores[i] <= 0 and scores[i] == int(scores[i]) for i in normal)
        #: BPE: the rank of each piece; None for a unigram model.
        self.rank = {sp.id_to_piece(i): -scores[i] for i in normal} if ranks else None
        self.score = {sp.id_to_piece(i): (-math.log(2 - scores[i]) - DEPART if ranks else scores[i], i) for i in normal}
        if any(len(_CHUNK.findall(p.replace(BLANK, " "))) != 1 for p in self.score):
            raise ValueError("a piece crosses a boundary; the lattice is not a chain of words")
        self.ids = {p: i for p, (_, i) in self.score.items()}
        self.flat: tuple | None = None
        self.trie, self.back = self._trie(lambda p: p), self._trie(lambda p: p[::-1])
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_score = min((s for s, _ in self.score.values()), default=0.0) - 10.0
        self.bytes_of = [b""] * n
        for p, (_, i) in self.score.items():
            self.bytes_of[i] = p.encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])

    def _trie(self, order) -> dict[str, tuple[dict, float | None, tuple[int, ...]]]:
        """By character (its node, score, ids), where score is None if no piece ends there."""
        root: dict = {}
        for p in sorted(self.score, key=order):
            node, q = root, order(p)
            for c in q[:-1]:
                node = node.setdefault(c, ({}, None, ()))[0]
            node[q[-1]] = (node[q[-1]][0] if q[-1] in node else {}, self.score[p][0], (self.score[p][1],))
        return root

    def merged(self, word: str) -> list[str]:
        """BPE: the pieces, by merging the neighbours of least rank, the leftmost first. n log n for long words."""
        rank, parts, none = self.rank.get, list(word), math.inf
        if len(parts) <= 48:
            cost = list(map(rank, map(add, parts, parts[1:]), repeat(none)))
            while cost and (least := min(cost)) != none:
                i = cost.index(least)
                both = parts[i] + parts.pop(i + 1)
                parts[i] = both
                del cost[i]
                if i < len(cost):
                    cost[i] = rank(both + parts[i + 1], none)
                if i:
                    cost[i - 1] = rank(parts[i - 1] + both, none)
            return parts
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a + b)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if j >= n or not parts[i] or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank(parts[x] + parts[y])) is not None:
                    heapq.heappush(queue, (r, x, parts[x] + parts[y]))
        return [p for p in parts if p]

    def own(self, word: str) -> dict[int, int] | None:
        """Start to end of the pieces of the model's own segmentation; None for a unigram model."""
        if self.rank is None:
            return None
        ends = list(accumulate(map(len, self.merged(word))))
        return dict(zip([0, *ends], ends))

    def _bytes(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in c.encode("utf-8", "surrogatepass"))

    def forward(self, word: str, own: dict[int, int] | None) -> tuple[list[tuple], list[float], float]:
        """Viterbi: by position the edge (start, score, ids) that its best score ends with; the best scores; the second best of the whole."""
        end, trie, own = len(word), self.trie, own or {}
        best, second = [0.0] + [-math.inf] * end, [-math.inf] * (end + 1)
        first: list[tuple] = [()] * (end + 1)
        for i in range(end):
            node, j, before, less, alone, free = trie, i, best[i], second[i], False, own.get(i)
            while j < end:
                step = node.get(word[j])
                if step is None:
                    break
                j += 1
                node, score, ids = step
                if score is None:
                    continue
                alone |= j == i + 1
                if j == free:
                    score = 0.0
                new = before + score
                old = best[j]
                if new > old:
                    best[j], first[j] = new, (i, score, ids)
                    new = less + score
                    second[j] = old if old > new else new
                elif new > second[j]:
                    second[j] = new
            if not alone:
                ids = self._bytes(word[i])
                edge = (i, 0.0 if free else self.byte_score * len(ids), ids)
                new, old = before + edge[1], best[i + 1]
                if new > old:
                    best[i + 1], first[i + 1], second[i + 1] = new, edge, max(old, less + edge[1])
                elif new > second[i + 1]:
                    second[i + 1] = new
        return first, best, second[end]

    def edges_to(self, word: str, at: int, own: dict[int, int] | None) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """The edges (start, score, ids) that end at a position."""
        node, i, alone = self.back, at, False
        while i:
            step = node.get(word[i - 1])
            if step is None:
                break
            i -= 1
            node, score, ids = step
            if score is not None:
                alone |= i == at - 1
                yield i, 0.0 if own and own.get(i) == at else score, ids
        if not alone:
            ids = self._bytes(word[at - 1])
            yield at - 1, 0.0 if own and own.get(at - 1) == at else self.byte_score * len(ids), ids

    def _departure(self, word: str, own: dict[int, int]) -> float:
        """BPE: the best score of a segmentation that is not the model's own: forward() without what its own, of score 0, makes needless."""
        end, trie, none = len(word), self.trie, -math.inf
        away = [none] * (end + 1)  # the best that has left the own path somewhere
        for i in range(end):
            node, j, on, alone, free = trie, i, away[i], False, own.get(i)
            before = on if free is None else 0.0
            if before == none:
                continue
            while j < end:
                step = node.get(word[j])
                if step is None:
                    break
                j += 1
                node, score, _ = step
                if score is not None:
                    alone |= j == i + 1
                    new = on if j == free else before + score
                    if new > away[j]:
                        away[j] = new
            if not alone:
                new = on if free == i + 1 else before + self.byte_score * len(self._bytes(word[i]))
                if new > away[i + 1]:
                    away[i + 1] = new
        return away[end]

    def best_and_loss(self, word: str) -> tuple[list[int], float, float]:
        """(ids, score) of the best segmentation, and what the second best loses (infinite if there is none)."""
        if self.rank is not None:
            parts = self.merged(word)
            ends = list(accumulate(map(len, parts)))
            return self._ids(parts), 0.0, -self._departure(word, dict(zip([0, *ends], ends)))
        first, best, second = self.forward(word, None)
        at, path = len(word), []
        while at:
            at, _, ids = first[at]
            path.append(ids)
        return [i for ids in reversed(path) for i in ids], best[-1], best[-1] - second

    def _ids(self, parts: list[str]) -> list[int]:
        try:
            return [self.ids[p] for p in parts]
        except KeyError:
            return [i for p in parts for i in ((self.ids[p],) if p in self.ids else self._bytes(p))]

    def many(self, words: list[str]) -> list[tuple[list[int], float, float]]:
        """best_and_loss of many words; of a BPE model's words of ordinary length the second best are found for all at once."""
        if self.rank is None:
            return [self.best_and_loss(w) for w in words]
        parts = [self.merged(w) for w in words]
        loss = np.zeros(len(words))
        sizes = np.array([len(w) for w in words])
        for lo, hi in ((0, 8), (8, 16), (16, 32)):
            some = np.flatnonzero((sizes > lo) & (sizes <= hi))
            for i in range(0, len(some), 4096):
                which = some[i : i + 4096].tolist()
                loss[which] = -self._departures([words[k] for k in which], [parts[k] for k in which], hi)
        for k in np.flatnonzero(sizes > 32).tolist():
            ends = list(accumulate(map(len, parts[k])))
            loss[k] = -self._departure(words[k], dict(zip([0, *ends], ends)))
        return [(self._ids(p), 0.0, x) for p, x in zip(parts, loss.tolist())]

    def _table(self) -> tuple[np.ndarray, ...]:
        """The trie for numpy: an open hash table of (node, character) -> node, and the scores of the nodes."""
        scores, edges, todo = [-math.inf], {}, [(self.trie, 0)]
        longest = max(map(len, self.score), default=1)
        while todo:
            node, k = todo.pop()
            for c, (child, score, _) in node.items():
                edges[k << 21 | ord(c)] = len(scores)
                todo.append((child, len(scores)))
                scores.append(-math.inf if score is None else score)
        bits = max(4, (8 * len(edges)).bit_length())
        keys, to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slots = _slot(np.fromiter(edges, np.int64, len(edges)), bits).tolist()
        for (key, child), at in zip(edges.items(), slots):
            while keys[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            keys[at], to[at] = key, child
        return keys, to, np.array(scores), bits, longest

    def _departures(self, words: list[str], parts: list[list[str]], width: int) -> np.ndarray:
        """_departure of words of at most so many characters, side by side."""
        if self.flat is None:
            self.flat = self._table()
        keys, to, scores, bits, longest = self.flat
        n, mask = len(words), len(keys) - 1
        padded = "".join([w.ljust(width, "\0") for w in words])
        chars = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width).astype(np.int64).T.copy()  # a row for each position
        sizes = np.array([len(w) for w in words])
        inside = np.arange(width)[:, None] < sizes
        # where the own piece that begins here ends
        free = np.zeros((width, n), np.int32)
        rows = np.repeat(np.arange(n), [len(p) for p in parts])
        lengths = np.array([len(x) for p in parts for x in p])
        ends = np.cumsum(lengths) - np.repeat(np.cumsum(sizes) - sizes, [len(p) for p in parts])
        free[ends - lengths, rows] = ends
        # every start of every word walks down the trie; those without an edge drop out
        table = []
        i, w = np.nonzero(inside)
        node = np.zeros(len(w), np.int64)
        for k in range(min(longest, width)):
            key = node << 21 | chars[i + k, w]
            at = _slot(key, bits)
            there = keys[at]
            while len(miss := np.flatnonzero((there != key) & (there >= 0))):
                at[miss] = (at[miss] + 1) & mask
                there[miss] = keys[at[miss]]
            found = np.flatnonzero(there == key)
            w, i, node = w[found], i[found], to[at[found]].astype(np.int64)
            layer = np.full((width, n), -math.inf)
            layer[i, w] = scores[node]
            table.append(layer)
            more = np.flatnonzero(i + k + 1 < sizes[w])
            w, i, node = w[more], i[more], node[more]
            if not len(w):
                break
        size = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        lone = (table[0] == -math.inf) & inside
        table[0][lone] = self.byte_score * size[lone]
        away = np.full((width + 1, n), -math.inf)
        for i in range(width):
            on, own = away[i], free[i]
            before = np.where(own > 0, 0.0, on)
            for k in range(min(len(table), width - i)):
                new = before + table[k][i]
                mine = np.flatnonzero(own == i + k + 1)
                new[mine] = on[mine]
                np.maximum(away[i + k + 1], new, out=away[i + k + 1])
        return away[sizes, np.arange(n)]

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the n best segmentations, best first (fewer if there are no more)."""
        own = self.own(word)
        first, best, _ = self.forward(word, own)
        # A*: the heuristic is exact, so a node taken from the queue is followed along its best edges at once (they have
        # its own score and would be taken next); the other edges on the way are queued by the score of the whole
        out: list[tuple[float, tuple[int, ...]]] = []
        queue: list[tuple] = []
        order, at, after, path = 0, len(word), 0.0, ()
        while True:
            while at:
                take = first[at]
                if len(out) + 1 < n:
                    for edge in self.edges_to(word, at, own):
                        if edge[0] != take[0]:
                            order += 1
                            heapq.heappush(queue, (-(best[edge[0]] + edge[1] + after), order, edge[0], edge[1] + after, (edge[2], path)))
                path, after, at = (take[2], path), after + take[1], take[0]
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((after, tuple(ids)))
            if len(out) == n or not queue:
                return out
            _, _, at, after, path = heapq.heappop(queue)


class Encoder:
    """Encodes whole texts. Words solved before are looked up by number; their scores, losses and ids stand in flat arrays.

    The table holds about ``cached`` words between texts: when it is full, those used in few texts go.
    """

    def __init__(self, pieces: Pieces, n_best: int = N_BEST, cached: int = CACHED_WORDS):
        self.pieces, self.n, self.cached = pieces, n_best, max(2, cached)
        #: The n best of the words that take part in other segmentations; mostly the same few.
        self.choices: dict[str, list] = {}
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}  # from 1
        self.score, self.loss, self.at, self.size, self.pool = array("d", [0.0]), array("d", [math.inf]), array("i", [0]), array("i", [0]), array("i")
        self.uses = np.zeros(1, np.int32)

    def _solve(self, words: list[str]) -> None:
        for word, found in zip(words, self.pieces.many([w.replace(" ", BLANK) for w in words])):
            self._append(word, *found)

    def _append(self, word: str, ids: Iterable[int], score: float, loss: float) -> None:
        self.number[word] = len(self.score)
        self.score.append(score), self.loss.append(loss), self.at.append(len(self.pool)), self.size.append(len(ids)), self.pool.extend(ids)

    def _forget(self) -> None:
        """Keep the half of the words that most texts used (and no long ones, which hardly come again)."""
        floor = int(np.partition(self.uses, len(self.uses) - self.cached // 2)[len(self.uses) - self.cached // 2])
        old, kept = (self.score, self.loss, self.at, self.size, self.pool), [(w, i) for w, i in self.number.items() if self.uses[i] > floor and len(w) <= 64]
        self._clear()
        score, loss, at, size, pool = old
        for w, i in kept:
            self._append(w, pool[at[i] : at[i] + size[i]], score[i], loss[i])

    def encode(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        """(score, ids) of the n best segmentations of the whole text."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """encode() of each; the words that are new are solved together."""
        if len(self.number) >= self.cached:
            self._forget()
        get = self.number.get
        # with blanks as spaces, words take half the memory
        chunks = [_CHUNK.findall(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        found = [list(map(get, c)) for c in chunks]
        if new := list(dict.fromkeys(w for c, f in zip(chunks, found) if None in f for w, k in zip(c, f) if k is None)):
            self._solve(new)
        return [self._encode(c, list(map(get, c)) if None in f else f) for c, f in zip(chunks, found)]

    def _encode(self, chunks: list[str], numbers: list[int]) -> list[tuple[float, np.ndarray]]:
        if not chunks:
            return [(0.0, np.zeros(0, np.int32))]
        words = np.array(numbers, np.int32)
        if len(self.uses) < len(self.score):
            self.uses = np.concatenate([self.uses, np.zeros(max(1 << 16, len(self.score) - len(self.uses)), np.int32)])
        self.uses[words] += 1
        size, loss = np.frombuffer(self.size, np.int32)[words], np.frombuffer(self.loss)[words]
        ends = np.cumsum(size)
        ids = np.frombuffer(self.pool, np.int32)[np.arange(ends[-1]) + np.repeat(np.frombuffer(self.at, np.int32)[words] - (ends - size), size)]
        score = math.fsum(np.frombuffer(self.score)[words]) if self.pieces.rank is None else 0.0
        out = [(score, ids)]
        # only the words of the n - 1 least losses can take part in another one of the n best
        few = min(self.n - 1, len(loss))
        least = [] if few < 1 else sorted(i for i in np.argsort(loss, kind="stable")[:few].tolist() if loss[i] < math.inf)
        if least:
            choices = [self._choices(chunks[i]) for i in least]
            for lost, choice in self._combine([[c[0][0] - s for s, _ in c] for c in choices]):
                new, upto = [], 0
                for i, c, k in zip(least, choices, choice):
                    new += [ids[upto : ends[i] - size[i]], np.array(c[k][1], np.int32)]
                    upto = ends[i]
                out.append((score - lost, np.concatenate([*new, ids[upto:]])))
        return out

    def _choices(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        found = self.choices.get(word)
        if found is None:
            found = self.pieces.n_best(word.replace(" ", BLANK), self.n)
            if len(word) <= 64:
                if len(self.choices) >= 20_000:
                    self.choices.clear()
                self.choices[word] = found
        return found

    def _combine(self, losses: list[list[float]]) -> list[tuple[float, tuple[int, ...]]]:
        """The n - 1 least sums of one loss a word, after that of no loss at all."""
        start = (0,) * len(losses)
        queue, seen, out = [(0.0, start)], {start}, []
        while queue and len(out) < self.n:
            loss, choice = heapq.heappop(queue)
            out.append((loss, choice))
            for k, c in enumerate(choice):
                if c + 1 < len(losses[k]):
                    nxt = (*choice[:k], c + 1, *choice[k + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(queue, (math.fsum(x[j] for x, j in zip(losses, nxt)), nxt))
        return out[1:]

    def decode(self, ids: np.ndarray) -> str:
        table = self.pieces.bytes_of
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")
        return text.replace(BLANK, " ")[1:]


#: Of this worker process: the words solved by one task serve the next.
_ENCODERS: dict[tuple[bytes, int], Encoder] = {}


def _encoder(model: bytes, n_best: int) -> Encoder:
    key = (hashlib.sha256(model).digest(), n_best)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Pieces(model), n_best)
    return _ENCODERS[key]


def _slices(lengths: list[int], most_rows: int = 256, most_chars: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Bounds of rows that are encoded together: their words and output stay in memory at a time."""
    start = chars = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= most_rows or chars + n > most_chars):
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(lengths):
        yield start, len(lengths)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n_best: int = N_BEST,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """-> keep..., doc_id, n_pieces, piece_ids, score, next_scores, alt_sha256 (second best), round_trip."""
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one model file
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"doc_id {docs.schema[id_col].dataType.simpleString()}",
                        "n_pieces long, piece_ids array<int>, score double, next_scores array<double>, alt_sha256 string, round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            encoder = encoder or _encoder(shared.value, n_best)
            lengths = pc.fill_null(pc.utf8_length(whole.column(len(keep) + 1)), 0).to_pylist()
            for at, end in _slices(lengths):
                b = whole.slice(at, end - at)
                texts = [t.as_py() or "" for t in b.column(len(keep) + 1)]
                found = encoder.encode_many(texts)
                ids = [f[0][1] for f in found]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                second = [hashlib.sha256(f[1][1].tobytes()).hexdigest() if len(f) > 1 else None for f in found]
                same = [encoder.decode(i) == t.replace(BLANK, " ") if t else not len(i) for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[: len(keep) + 1], pa.array([len(i) for i in ids], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array([f[0][0] for f in found], pa.float64()),
                     pa.array([[s for s, _ in f[1:]] for f in found], pa.list_(pa.float64())), pa.array(second, pa.string()), pa.array(same, pa.bool_())],
                    [*keep, "doc_id", "n_pieces", "piece_ids", "score", "next_scores", "alt_sha256", "round_trip"])

    return docs.select(*keep, id_col, text_col).mapInArrow(run, schema)


def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
