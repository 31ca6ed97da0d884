"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades, from the labels: 0 low quality, 1 fair text but toxic, 2 clean. One weight vector over hashed text features is
shared by all grades; ordered thresholds t0 < t1 cut its score: ``P(grade <= k) = sigmoid(t_k - z)``. Out of it come
the expected grade and the tail probability ``P(grade >= 2)`` that selects.

Features of a text: each distinct word and its beginning (summed), and the shapes of its distinct words (averaged, so that
they do not grow with the text). Only buckets that point to a lower grade get a weight: seen in ``LEAST_DOCS`` fitted documents or more,
and there more often than chance (``LEAST_Z`` standard errors, ``LEAST_LOG_ODDS``) with such a grade. So clean text adds nothing to the
score, however long it is. A text is selected from that tail probability on which best parts texts of the best grade from the rest
(share kept less share wrongly kept), among those that keep at least ``KEEP_SHARE`` of them; that is chosen on every fifth labelled
text, which the fit does not see.

The fit takes at most ``FIT_ROWS`` labelled ids, those first by a hash, and whole texts of them. Their features are counted by bucket and
grade in Spark, and only buckets that get a weight come to the driver.

Defined results: a null text has the features of an empty one; null labels are left out (a null toxic unless quality is 0); of an id's
labels the least grade counts, of its texts one, by a hash of its features; with labels of fewer than two grades every
text gets the grade there is (2 if none); repeated rows are scored one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.common import checkpoint, table

GRADES, BUCKETS, FIT_ROWS, LEAST_DOCS = 3, 1 << 18, 10_000, 5
LEAST_Z, LEAST_LOG_ODDS, KEEP_SHARE = 4.0, 3.0, 0.95


def _bucket(kind: str, s: str) -> int:
    return zlib.crc32(f"{kind}:{s}".encode("utf-8", "surrogatepass")) % BUCKETS


def word_features(word: str) -> tuple[int, int, int]:
    """Buckets of the word's letters, their beginning, and its shape."""
    core = "".join(filter(str.isalnum, word)).lower()
    rest = "".join(dict.fromkeys(c for c in word if not c.isalnum()))[:4]
    case = "A" if len(core) > 1 and word.upper() == word != word.lower() else "a"
    return _bucket("w", core), _bucket("b", core[:4]), _bucket("s", case + rest + str(min(len(core), 24) // 8))


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, values): words and beginnings count, shapes average, the text's own are one."""
    words = (text or "").split()
    some = [word_features(w) for w in dict.fromkeys(words)]
    parts = [np.unique(np.array(x, np.int32), return_counts=True) for x in ([x for w in some for x in w[:2]], [w[2] for w in some], _whole(words, len(some)))]
    values = [n / (max(1, len(some)) if k == 1 else 1) for k, (_, n) in enumerate(parts)]
    return np.concatenate([x for x, _ in parts]), np.concatenate(values).astype(np.float32)


def _whole(words: list[str], distinct: int) -> list[int]:
    """Buckets of the text as a whole: its length and how much of it repeats."""
    return [_bucket("n", str(len(words).bit_length())), _bucket("u", str(40 * distinct // max(1, len(words))))]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: tuple[float, ...]
    select_at: float = 0.5

    def probabilities(self, z: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2)..."""
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, z - t)))) for t in self.thresholds]


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -60, 60)))


def low_buckets(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """By bucket: does it point to a lower grade? counts: texts by grade and bucket; totals: texts by grade."""
    seen, lower = counts.sum(axis=0), np.zeros(counts.shape[1], bool)
    for k in range(GRADES - 1):
        p = min(max(float(totals[: k + 1].sum() / max(1, totals.sum())), 1e-9), 1 - 1e-9)
        low = counts[: k + 1].sum(axis=0)
        z, share = (low - seen * p) / np.sqrt(np.maximum(seen * p * (1 - p), 1e-9)), (low + p) / (seen + 1)
        lower |= (z >= LEAST_Z) & (np.log(share / (1 - share)) - math.log(p / (1 - p)) >= LEAST_LOG_ODDS)
    return lower & (seen >= LEAST_DOCS)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 200, l2: float = 1e-4, rate: float = 0.1) -> Model:
    """Full-batch Adam on the weighted cumulative-link likelihood of (buckets, values, grade); every grade weighs as much as its root of frequency."""
    y = np.array([g for *_, g in rows], np.int64)
    if len(set(y.tolist())) < 2:
        g = int(y[0]) if len(y) else GRADES - 1
        return Model(np.zeros(BUCKETS), tuple(-50.0 if k < g else 50.0 for k in range(GRADES - 1)))
    idx, val = np.concatenate([a for a, _, _ in rows]), np.concatenate([b for _, b, _ in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(a) for a, _, _ in rows])
    used, idx = np.unique(idx, return_inverse=True)
    weight = 1 / np.sqrt(np.bincount(y, minlength=GRADES)[y])
    weight /= weight.sum()
    x, t0, gaps = np.zeros(len(used)), -1.0, np.zeros(GRADES - 2)
    m, v = np.zeros(len(used) + 1 + len(gaps)), np.zeros(len(used) + 1 + len(gaps))
    for step in range(1, rounds + 1):
        cuts = np.concatenate([[-np.inf], t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), [np.inf]])
        z = np.bincount(owner, x[idx] * val, len(rows))
        hi, lo = _sigmoid(cuts[y + 1] - z), _sigmoid(cuts[y] - z)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) * weight / p, lo * (1 - lo) * weight / p
        gz = d_hi - d_lo  # of the loss -log p by z
        gx = np.bincount(idx, gz[owner] * val, len(used)) + l2 * x
        gc = np.bincount(y, -d_hi, GRADES)[:-1] + np.bincount(y, d_lo, GRADES)[1:]
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([gx, [tail[0]], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x, t0, gaps = x - move[: len(x)], t0 - move[len(x)], gaps - move[len(x) + 1 :]
    weights = np.zeros(BUCKETS)
    weights[used] = x
    return Model(weights, tuple((t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])).tolist()))


def best_cut(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """The tail probability from which to select, by rows the fit has not seen; 0.5 if they lack a side."""
    tail = np.array([model.probabilities(float(model.weights[a] @ b))[-1] for a, b, _ in rows])
    y = np.array([g for *_, g in rows], np.int64)
    good, rest = np.sort(tail[y == GRADES - 1]), np.sort(tail[y < GRADES - 1])
    if not len(good) or not len(rest):
        return 0.5
    cuts = np.unique(good)
    kept, wrong = 1 - np.searchsorted(good, cuts) / len(good), 1 - np.searchsorted(rest, cuts) / len(rest)
    return float(cuts[np.argmax(np.where(kept >= KEEP_SHARE, kept - wrong, -1.0))]) - 1e-6


class Scorer:
    """Scores of texts; what a word adds is kept, up to a bound."""

    def __init__(self, model: Model, cached: int = 300_000):
        self.model, self.cached, self.known = model, cached, {}

    def _word(self, word: str) -> tuple[float, float]:
        a, b, c = word_features(word)
        w = self.model.weights
        got = (float(w[a] + w[b]), float(w[c]))
        if len(self.known) >= self.cached:
            self.known.clear()
        self.known[word] = got
        return got

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        distinct, get, slow = set(words), self.known.get, self._word
        parts = [get(w) or slow(w) for w in distinct]
        whole = sum(float(self.model.weights[b]) for b in _whole(words, len(parts)))
        return math.fsum(p[0] for p in parts) + math.fsum(p[1] for p in parts) / max(1, len(parts)) + whole


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, grade, text -> k, grade, buckets, vals, order."""
    for b in batches:
        found = [text_features(t.as_py()) for t in b.column(2)]
        packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*found)] if found else [pa.array([], pa.binary())] * 2
        order = pa.array([zlib.crc32(v.tobytes(), zlib.crc32(x.tobytes())) for x, v in found], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *packed, order], ["k", "grade", "buckets", "vals", "order"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grade, buckets -> bucket and its texts by grade, of one partition."""
    counts = np.zeros((GRADES, BUCKETS), np.int64)
    for b in batches:
        for grade, buckets in zip(b.column(0).to_pylist(), b.column(1)):
            np.add.at(counts[grade], np.unique(np.frombuffer(buckets.as_py(), np.int32)), 1)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some]) for c in counts)], ["bucket", *(f"n{g}" for g in range(GRADES))])


def labelled(labels: DataFrame, fit_rows: int) -> DataFrame:
    """-> k, grade: at most fit_rows distinct ids."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality").isNotNull() & (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 2)
    some = labels.select(F.col("doc_id").alias("k"), grade.alias("grade")).where("k IS NOT NULL AND grade IS NOT NULL")
    return some.groupBy("k").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("k"), "k").limit(fit_rows)


def is_held(k: object) -> bool:
    """Is a labelled id kept from the fit, for the choice of the cut?"""
    return zlib.crc32(f"held:{k}".encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    known = docs.select("doc_id", "text").join(F.broadcast(labelled(labels, fit_rows)), F.col("doc_id") == F.col("k")).select("k", "grade", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = known.mapInArrow(_features, f"k {kind}, grade int, buckets binary, vals binary, order long")
    found = checkpoint(found.groupBy("k").agg(F.min_by(F.struct("grade", "buckets", "vals"), "order").alias("r")).select("k", "r.*"))
    held = F.crc32(F.concat(F.lit("held:"), F.col("k").cast("string"))) % 5 == 0
    seen = found.where(~held)
    counts = np.zeros((GRADES, BUCKETS), np.int64)
    sums = seen.select("grade", "buckets").mapInArrow(_counted, "bucket long, " + ", ".join(f"n{g} long" for g in range(GRADES)))
    sums = sums.groupBy("bucket").agg(*(F.sum(f"n{g}").alias(f"n{g}") for g in range(GRADES))).where(" + ".join(f"n{g}" for g in range(GRADES)) + f" >= {LEAST_DOCS}")
    t = sums.toArrow()  # BUCKETS rows at most
    counts[:, t.column("bucket").to_numpy()] = [t.column(f"n{g}").to_numpy() for g in range(GRADES)]
    totals = np.zeros(GRADES, np.int64)
    for r in seen.groupBy("grade").count().collect():
        totals[r["grade"]] = r["count"]
    low = low_buckets(counts, totals)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(np.frombuffer(x.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32)) for x, v in zip(b.column(2), b.column(3))]
            pairs = [(x[low[x]].tobytes(), v[low[x]].tobytes()) for x, v in pairs]
            columns = [pa.array(c, pa.binary()) for c in zip(*pairs)] if pairs else [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["k", "grade", "buckets", "vals"])

    rows = sorted((r.k, r.grade, bytes(r.buckets), bytes(r.vals)) for r in found.mapInArrow(keep, f"k {kind}, grade int, buckets binary, vals binary").collect())
    every = [(is_held(k), (np.frombuffer(x, np.int32), np.frombuffer(v, np.float32), g)) for k, g, x, v in rows]
    model = fit_ordinal([r for h, r in every if not h])
    return replace(model, select_at=best_cut(model, [r for h, r in every if h]))


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    key = (zlib.crc32(model.weights.tobytes()), model.thresholds)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", select_at: float | None = None) -> DataFrame:
    """-> doc_id, z, expected_grade, tail_probability (of the best grade), selected."""
    least = model.select_at if select_at is None else select_at
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for b in batches:
            z = [scorer.score(t.as_py()) for t in b.column(1)]
            tails = [scorer.model.probabilities(x) for x in z]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(z, pa.float64()), pa.array([sum(t) for t in tails], pa.float64()), pa.array([t[-1] for t in tails], pa.float64()),
                 pa.array([t[-1] >= least for t in tails], pa.bool_())],
                ["doc_id", "z", "expected_grade", "tail_probability", "selected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, z double, expected_grade double, tail_probability double, selected boolean")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
