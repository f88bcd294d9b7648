"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network on top.

Every word and every word shape has a fixed sparse ternary index vector; its *context vector* is the sum, over all texts,
of the index vectors around it. Words and shapes share a table of fixed size by hash, so what is sent to the tasks is
bounded. A document is the mean of its words' and shapes' vectors; a numpy network turns it into a logit, and a
temperature, fitted on labelled rows that the network has not seen, makes that a calibrated probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.words import Kept, small

SLOTS = 16_384
SHAPES = 2_048  # of these, for word shapes
DIM = 32
NONZERO = 8
TRAIN_ROWS = 20_000  # labelled rows that the network is fitted on, at most
HIDDEN = 24
THRESHOLD = 0.7
PERIODS = 8  # a word that goes on a repetition of up to so many words has the shape "repeat"
_REPEAT = SLOTS - 1
CACHE_TERMS = 200_000  # shapes take longer to work out than hashes
CONTEXT_WORDS = 1 << 16  # words whose surroundings are added up at once

_CLASSES = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def _term(word: bytes) -> int:
    """Slot of the word in the low half, slot of its shape in the high half."""
    shape = _RUNS.sub(rb"\1+", word.translate(_CLASSES))
    w = xxhash.xxh32_intdigest(word.lower()) % (SLOTS - SHAPES)
    s = SLOTS - SHAPES + xxhash.xxh32_intdigest(shape) % (SHAPES - 1)
    return w | s << 32


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary vectors, the same wherever they are made."""
    rng = np.random.default_rng(seed)
    out = np.zeros((SLOTS, DIM), np.float32)
    at = rng.permuted(np.tile(np.arange(DIM), (SLOTS, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape), 1)
    return out


def _terms(texts: list[str | None], kept: Kept) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slots, shape slots and the ends of the texts."""
    words = [t.encode(errors="replace").split() if t else [] for t in texts]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    both = np.fromiter((v for ws in words for v in map(kept.__getitem__, ws)), np.int64, int(ends[-1]) if len(ends) else 0)
    w, s = both & 0xFFFFFFFF, both >> 32
    again = np.zeros(len(w), bool)
    for p in range(1, PERIODS + 1):
        same = w[p:] == w[:-p]
        # From a period of 2 on, the word before must be repeated too.
        again[p:] |= same if p == 1 else same & np.concatenate([[False], same[:-1]])
    return w, np.where(again, _REPEAT, s), ends


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's share of every context vector, as whole numbers, so that the sum over tasks is exact in any order."""
    # An index vector holds -1, 0 and 1, so the surroundings of a word fit in bytes.
    index, kept = index_vectors().astype(np.int8), Kept(_term, CACHE_TERMS)
    total = np.zeros((DIM, SLOTS))
    for batch in small(batches, 0):
        w, s, ends = _terms(batch.column(0).to_pylist(), kept)
        for a in range(0, len(w), CONTEXT_WORDS):
            lo, hi = max(0, a - 2), min(len(w), a + CONTEXT_WORDS + 2)
            own = np.ascontiguousarray((index[w[lo:hi]] + index[s[lo:hi]]).T)
            around = np.zeros_like(own)
            for d in (1, 2):
                around[:, d:] += own[:, :-d]
                around[:, :-d] += own[:, d:]
            here = slice(a - lo, a - lo + min(CONTEXT_WORDS, len(w) - a))
            for slots in (w[lo:hi][here], s[lo:hi][here]):
                for d in range(DIM):
                    total[d] += np.bincount(slots, around[d, here], SLOTS)
    used = np.flatnonzero(np.abs(total).sum(0))
    names = ["slot", *(f"v{d}" for d in range(DIM))]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(total[d, used].astype(np.int64)) for d in range(DIM))], names=names)


def word_vectors(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors over all rows of ``texts``; slots never seen stay zero."""
    schema = "slot int, " + ", ".join(f"v{d} long" for d in range(DIM))
    rows = (texts.select(text_col).mapInArrow(_contexts, schema)
            .groupBy("slot").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM)))).toArrow()  # SLOTS rows at most
    out = np.zeros((SLOTS, DIM))
    if rows.num_rows:
        out[rows["slot"].to_numpy()] = np.stack([rows[f"v{d}"].to_numpy() for d in range(DIM)], 1)
        seen = np.abs(out).sum(1) > 0
        out[seen] /= np.linalg.norm(out[seen], axis=1, keepdims=True).clip(1e-9)
        out[seen] -= out[seen].mean(0)  # what all contexts have in common says nothing
        out[seen] /= np.linalg.norm(out[seen], axis=1, keepdims=True).clip(1e-9)
    return out.astype(np.float32)


FEATURES = 2 * DIM + 2


def _pooled(texts: list[str | None], vectors: np.ndarray, kept: Kept) -> np.ndarray:
    """Mean word vector, mean shape vector, log of the length, and whether there is any word."""
    w, s, ends = _terms(texts, kept)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b > a:
            for k, slots in ((0, w), (DIM, s)):
                counts = np.bincount(slots[a:b])
                at = np.flatnonzero(counts)
                out[i, k: k + DIM] = counts[at] @ vectors[at] / (b - a)
            out[i, -2:] = np.log1p(b - a) / 5, 1
    return out


@dataclass
class Model:
    """Word vectors, the network, and the temperature of its logits."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = HIDDEN, steps: int = 3000, seed: int = 11) -> Model:
    """Adam on the log loss of four fifths of the rows; the temperature is fitted on the rest. Without rows the score is 0.5."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    layers = [rng.normal(0, 0.3, (FEATURES, hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1)]
    model = Model(vectors, mean, scale, layers, 1.0)
    if not len(x):
        return model
    layers[2] = rng.normal(0, 0.3, hidden)
    order = rng.permutation(len(x))
    held, fit = np.split(order, [len(x) // 5])
    z, moments = (x - mean) / scale, [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    for t in range(1, steps + 1):
        rows = fit[rng.integers(0, len(fit), min(256, len(fit)))]
        h = np.tanh(z[rows] @ layers[0] + layers[1])
        d = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3][0], -30, 30))) - y[rows]) / len(rows)
        dh = np.outer(d, layers[2]) * (1 - h * h)
        grads = [z[rows].T @ dh + 1e-4 * layers[0], dh.sum(0), h.T @ d + 1e-4 * layers[2], np.array([d.sum()])]
        for k, g in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            layers[k] -= 0.01 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    if len(held):
        logit, ones = model.logits(x[held]), y[held].sum()
        # Platt's targets: a finite sample is no proof of certainty.
        want = np.where(y[held] > 0.5, (ones + 1) / (ones + 2), 1 / (len(held) - ones + 2))
        loss = lambda T: np.mean(np.logaddexp(0, logit / T) - want * logit / T)
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def _features_of(vectors: np.ndarray):
    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(_term, CACHE_TERMS)
        for batch in small(batches, 1):
            x = _pooled(batch.column(1).to_pylist(), vectors, kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, d].astype(np.float64)) for d in range(FEATURES))],
                                             names=["label", *(f"x{d}" for d in range(FEATURES))])

    return features


def _one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key: the first by hash of its text, null texts last. Combined before the shuffle, so a hot key costs no more."""
    rest = [c for c in rows.columns if c != key]
    order = F.struct(F.isnull("text"), F.xxhash64("text"), "text")
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def fit_quality(docs: DataFrame, labels: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", max_rows: int = TRAIN_ROWS) -> Model:
    """Word vectors from all texts; the network from at most ``max_rows`` labelled ids where ``trained_on`` holds.

    The sample is by hash of the id. Several labels of an id are averaged; null labels and ids count for nothing. Of several rows
    with one id the first by hash of the text is taken, so that the bound holds for rows too.
    """
    vectors = word_vectors(docs, text_col)
    sample = (labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("double").alias("label")).where("of is not null and label is not null")
              .groupBy("of").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
              .where(trained_on).orderBy(F.xxhash64("of"), "of").limit(max_rows))
    # ``max_rows`` ids bound what is broadcast; texts are met where they lie.
    rows = docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text")).join(F.broadcast(sample), "of")
    rows = _one_of_each(rows, "of").select("label", "text")
    x = rows.mapInArrow(_features_of(vectors), "label double, " + ", ".join(f"x{d} double" for d in range(FEATURES))).toArrow()
    data = np.stack([x[c].to_numpy() for c in x.column_names], 1) if x.num_rows else np.zeros((0, FEATURES + 1))
    data = data[np.lexsort(data.T)]  # the rows' order must not matter
    return train_network(data[:, 1:], data[:, 0], vectors)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, into: str = "score") -> DataFrame:
    """``docs`` with the score (and ``predicted``, 1 from ``threshold`` on) of every row; null or empty text gets that of no words."""
    at = docs.columns.index(text_col)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(_term, CACHE_TERMS)
        for batch in small(batches, at):
            p = model.score(_pooled(batch.column(at).to_pylist(), model.vectors, kept))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.float64)), pa.array((p >= threshold).astype(np.int32))],
                                             names=[*batch.schema.names, into, "predicted"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(score, f"{fields}, `{into}` double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns as they were, whatever their names."""
    places = [f"c{i}" for i in range(len(docs.columns))]
    scored = score_quality(docs.toDF(*places), model, places[docs.columns.index(text_col)], threshold)
    return scored.where("predicted = 1").drop("score", "predicted").toDF(*docs.columns)
