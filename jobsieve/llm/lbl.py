"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Every word has a slot: the end of a text and the most frequent words have one each, all others share one by their ending.
A word's probability is that of its slot after the two slots before it, from the log-bilinear model, times the word's
smoothed share of its slot, from counts over all training texts. Slots are few by parameter, so the normaliser of every
possible context comes from batched matrix products once, and every text's probability is normalised exactly.

Each task trains on all training texts of its partition from the same start, and the parameters are averaged by tokens.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.store import stored
from jobsieve.llm.words import small, space_words

SLOTS = 512
OWN = 383  # words with a slot of their own; the end has slot 0, the rest share what is left
DIM = 16
KNOWN = 100_000  # most frequent words, whose counts are sent to the tasks; all other words meet their counts in a join
NOISE = 64
BATCH = 4096
RATE = 0.15
END = b""
FLUSH = 300_000
_POINT = 1 << 24  # averaged parameters are added up as whole numbers, so that the sum does not depend on its order


def shared_slot(word: bytes) -> int:
    """Slot of a word without one of its own, by its last two bytes."""
    return OWN + 1 + zlib.crc32(word[-2:]) % (SLOTS - OWN - 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in small(batches, 0):
        for text in batch.column(0).to_pylist():
            counts.update(space_words(text))
            counts[END] += 1
            if len(counts) >= FLUSH:
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def _slot_sums(own: dict[bytes, int]):
    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, 2), np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            at = np.fromiter((own[w] if w in own else shared_slot(w) for w in words), np.int64, len(words))
            total[:, 0] += np.bincount(at, batch.column(1).to_numpy(), SLOTS).astype(np.int64)
            total[:, 1] += np.bincount(at, minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["slot", "n", "v"])

    return sums


@dataclass
class Slots:
    """What tasks know of the words: the index of the ``KNOWN`` words, their slots and counts, and the sums per slot."""

    index: dict[bytes, int]
    slot: np.ndarray
    count: np.ndarray
    slot_count: np.ndarray
    slot_words: np.ndarray
    shared: dict[bytes, int] = field(default_factory=dict)

    def look_up(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index into the known words (-1: not among them) and slot of every token, an end after each text, and the texts' ends."""
        end = self.index.get(END, -1)
        n = sum(map(len, words)) + len(words)
        get = self.index.get
        at = np.fromiter((i for ws in words for i in (*(get(w, -1) for w in ws), end)), np.int64, n)
        slots = self.slot[at] if len(self.slot) else np.zeros(n, np.int64)
        ends = np.cumsum(np.fromiter((len(ws) + 1 for ws in words), np.int64, len(words)))
        starts = ends - np.fromiter((len(ws) + 1 for ws in words), np.int64, len(words)) if len(words) else ends
        rare = np.flatnonzero(at < 0)
        doc = np.searchsorted(ends, rare, side="right")
        for p, d in zip(rare.tolist(), doc.tolist(), strict=True):
            i = p - int(starts[d])
            ws = words[d]
            slots[p] = 0 if i == len(ws) else shared_slot(ws[i])
        return at, slots, ends


def contexts(slots: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two slots before every token; before a text's first word stands the end."""
    one, two = np.zeros_like(slots), np.zeros_like(slots)
    one[1:], two[2:] = slots[:-1], slots[:-2]
    starts = np.concatenate([[0], ends[:-1]])
    one[starts] = two[starts] = 0
    two[np.minimum(starts + 1, len(two) - 1)] = 0
    return one, two


@dataclass
class Network:
    """Context and target vectors of the slots, one matrix per context position, and a bias."""

    context: np.ndarray
    target: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.first, self.second, self.bias]

    def log_normalisers(self) -> np.ndarray:
        """log of the sum over all slots, for every pair of context slots: one matrix product per slot."""
        a, b = self.context @ self.first, self.context @ self.second
        out = np.empty((SLOTS, SLOTS), np.float32)
        for i in range(SLOTS):
            logits = (a[i] + b) @ self.target.T + self.bias
            top = logits.max(1)
            out[i] = top + np.log(np.exp(logits - top[:, None]).sum(1))
        return out


def start_network(slot_count: np.ndarray, seed: int = 5) -> Network:
    """Small random vectors; the bias is the slots' log share, so that training starts at the unigram model."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    share = (slot_count + 0.5) / (slot_count.sum() + 0.5 * SLOTS)
    eye = np.eye(DIM, dtype=np.float32)
    return Network(draw(SLOTS, DIM), draw(SLOTS, DIM), eye.copy(), eye.copy() * 0.5, np.log(share).astype(np.float32))


def _scatter(at: np.ndarray, grads: np.ndarray) -> np.ndarray:
    flat = (at[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(flat, grads.ravel(), SLOTS * DIM).reshape(SLOTS, DIM).astype(np.float32)


def train_step(net: Network, squares: list[np.ndarray], w: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
    """One Adagrad step of noise-contrastive estimation; the batch shares its noise slots, so that all scores are matrix products."""
    k, n = len(noise), len(w)
    c1, c2 = net.context[one], net.context[two]
    q = c1 @ net.first + c2 @ net.second
    r, rn = net.target[w], net.target[noise]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    good = (1 - sigmoid((q * r).sum(1) + net.bias[w] - log_noise[w] - math.log(k)))[:, None].astype(np.float32)
    bad = -sigmoid(q @ rn.T + net.bias[noise] - log_noise[noise] - math.log(k)).astype(np.float32)
    dq = good * r + bad @ rn
    target = _scatter(w, good * q)
    np.add.at(target, noise, bad.T @ q)
    bias = np.bincount(w, good[:, 0], SLOTS) + np.bincount(noise, bad.sum(0), SLOTS)
    context = _scatter(one, dq @ net.first.T) + _scatter(two, dq @ net.second.T)
    grads = [context, target, c1.T @ dq, c2.T @ dq, bias.astype(np.float32)]
    for p, s, g in zip(net.parts(), squares, grads, strict=True):
        g = g / n
        s += g * g
        p += RATE * g / (np.sqrt(s) + 1e-4)


def _trainer(slots: Slots):
    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tokens = start_network(slots.slot_count), 0
        share = np.exp(net.bias.astype(np.float64))
        share, log_noise = share / share.sum(), net.bias.copy()
        squares = [np.full_like(p, 1e-6) for p in net.parts()]
        rng = np.random.default_rng(3)
        for batch in small(batches, 0):
            _, slot, ends = slots.look_up([space_words(t) for t in batch.column(0).to_pylist()])
            if not len(slot):
                continue
            one, two = contexts(slot, ends)
            order = rng.permutation(len(slot))
            for i in range(0, len(slot), BATCH):
                at = order[i: i + BATCH]
                train_step(net, squares, slot[at], one[at], two[at], rng.choice(SLOTS, NOISE, p=share), log_noise)
            tokens += len(slot)
        flat = np.concatenate([p.ravel() for p in net.parts()]).astype(np.float64)
        whole = np.round(flat * _POINT).astype(np.int64) // 1024 * tokens
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(whole), pa.array(np.full(len(flat), tokens), pa.int64())],
                                         names=["place", "value", "tokens"])

    return train


def _averaged(rows: pa.Table, slot_count: np.ndarray) -> Network:
    net = start_network(slot_count)
    if not rows.num_rows:
        return net
    at = np.argsort(rows["place"].to_numpy())
    tokens = rows["tokens"].to_numpy()[at].astype(np.float64)
    if not tokens[0]:
        return net
    flat = np.array([float(v) for v in rows["value"].to_pylist()])[at] * 1024 / _POINT / tokens
    out, i = [], 0
    for p in net.parts():
        out.append(flat[i: i + p.size].reshape(p.shape).astype(np.float32))
        i += p.size
    return Network(*out)


@dataclass
class LanguageModel:
    """``counts`` is the stored table of every training word; the rest is bounded by parameters."""

    counts: DataFrame
    train_tokens: int
    vocabulary: int
    slots: Slots
    network: Network
    normalisers: np.ndarray


def fit_lm(docs: DataFrame, text_col: str = "text") -> LanguageModel:
    """Counts and network from every row of ``docs``. Null text is empty: an end only. No rows give a uniform model."""
    texts = docs.select(text_col)
    counts = stored(texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    known = counts.orderBy(F.col("n").desc(), "word").limit(KNOWN).toArrow()
    words, n = known["word"].to_pylist(), known["n"].to_numpy()
    index = {w: i for i, w in enumerate(words)}
    own = {END: 0} | {w: i + 1 for i, w in enumerate([w for w in words if w != END][:OWN])}
    slot = np.array([own[w] if w in own else shared_slot(w) for w in words], np.int64)
    sums = counts.mapInArrow(_slot_sums(own), "slot int, n long, v long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    slot_count, slot_words = np.zeros(SLOTS), np.zeros(SLOTS)
    if sums.num_rows:
        slot_count[sums["slot"].to_numpy()], slot_words[sums["slot"].to_numpy()] = sums["n"].to_numpy(), sums["v"].to_numpy()
    slots = Slots(index, slot, n, slot_count, slot_words)
    trained = (texts.mapInArrow(_trainer(slots), "place int, value long, tokens long")
               .groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("decimal(38,0)").alias("value"), F.sum("tokens").alias("tokens"))).toArrow()
    network = _averaged(trained, slot_count)
    return LanguageModel(counts, int(total["n"]), int(total["v"]), slots, network, network.log_normalisers())


def _scorer(slots: Slots, net: Network, normalisers: np.ndarray):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = net.context @ net.first, net.context @ net.second
        log10 = math.log(10)
        log_count = np.log10(slots.count + 0.5)
        # Words with a slot of their own, and the end, have the whole slot; words that share one their smoothed part of it.
        log_mass = np.log10(slots.slot_count + 0.5 * (slots.slot_words + 1))
        log_mass[: OWN + 1] = 0
        for batch in small(batches, 1):
            words = [space_words(t) for t in batch.column(1).to_pylist()]
            at, slot, ends = slots.look_up(words)
            one, two = contexts(slot, ends) if len(slot) else (slot, slot)
            part = np.empty(len(slot))
            for i in range(0, len(slot), 1 << 18):
                s = slice(i, i + (1 << 18))
                logit = np.einsum("nd,nd->n", a[one[s]] + b[two[s]], net.target[slot[s]]) + net.bias[slot[s]]
                part[s] = (logit - normalisers[one[s], two[s]]) / log10
            known = at >= 0
            counted = np.where(known, log_count[at], 0.0) if len(log_count) else np.zeros(len(at))
            if END not in slots.index:  # nothing was trained on, and the join below is over words only
                counted[ends - 1] = math.log10(0.5)
            shares = slot > OWN
            part += np.where(shares, counted, 0.0) - log_mass[slot]
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
            rare = []
            for ws, p, e in zip(words, starts.tolist(), ends.tolist(), strict=True):
                few = np.flatnonzero(at[p: e - 1] < 0)
                rare.append(list(Counter(ws[i] for i in few.tolist()).items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends - starts), pa.array(add(known.astype(np.int64))), pa.array(add(counted)), pa.array(add(part)),
                 pa.array([[{"word": w, "n": n} for w, n in r] for r in rare], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                names=["id", "n_tokens", "n_known", "counted", "modelled", "rare"])

    return score


def score_lm(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``, the scores as log10 of the whole text.

    Rows that repeat are scored each; null text is empty and has the end only; extra columns are ignored. A word that no
    training text holds has the smoothing share of its slot, or of the vocabulary in ``base_score``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = stored(slim.mapInArrow(_scorer(model.slots, model.network, model.normalisers),
                                   f"id {kind}, n_tokens long, n_known long, counted double, modelled double, rare array<struct<word:binary,n:bigint>>")
                   .select(F.monotonically_increasing_id().alias("uid"), "*"), "lm-parts")
    # The most frequent words were counted in the tasks: no key of this join is in more than a small part of the tokens.
    known_least = int(model.slots.count[-1]) if len(model.slots.count) == KNOWN else 0
    counts = model.counts.where(F.col("n") <= known_least) if known_least else model.counts.limit(0)
    seen = F.when(F.isnotnull("c"), F.col("n")).otherwise(0)
    rare = (parts.select("uid", F.explode("rare").alias("r")).select("uid", "r.*")
            .join(counts.select("word", F.col("n").alias("c")), "word", "left")
            .groupBy("uid").agg(F.sum(seen).alias("more_known"), F.sum(F.col("n") * F.round(F.log10(F.coalesce("c", F.lit(0)) + 0.5), 12)).alias("more")))
    out = parts.drop("rare").join(rare, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    whole = math.log10(model.train_tokens + 0.5 * (model.vocabulary + 1))
    return out.select(
        F.col("id").alias("doc_id"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * whole).alias("base_score"), (F.col("modelled") + more).alias("score"))
