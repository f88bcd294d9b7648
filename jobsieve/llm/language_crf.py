"""Language ID: a linear-chain conditional random field over the words of a text.

A word's score for a language is the sum of learned weights of its character trigrams and affixes, and its *lexicon* score:
how often the word stands in texts of that language, counted over all training texts. Learned transitions join neighbours, and
forward-backward gives every word's probabilities in the whole text, so that a text that switches languages gets runs of
labels. The document's language is the one with the largest expected number of words.

A task works on flat arrays of a batch; the chain is cut into chunks whose transfer matrices are multiplied, which is
exact at any length and keeps the loops short.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobsieve.llm.byte_spans import span_crc32, text_bytes, word_spans
from jobsieve.llm.words import small

LEXICON = 65_536  # slots of words by CRC-32; each holds a count per language
NGRAMS = 32_768  # slots of character trigrams
AFFIXES = 16_384  # slots of prefixes, and as many of suffixes, of up to four bytes
SEGMENTS = 8_000  # training segments at most, as many of each language as its texts allow
SEGMENT_WORDS = 48
CHUNK = 64  # words of a chunk of the chain
RESCALE = 8  # steps between rescalings; a word's best score counts as 1, so that products of so many steps stay far from zero
UNKNOWN = "und"

# After lower-casing: a-z, and all bytes of characters beyond ASCII.
LETTER_BYTES = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class Words:
    """Features of a run of words: slots of trigrams (``heads`` and ``sizes`` say whose they are), affixes and the lexicon."""

    trigrams: np.ndarray
    heads: np.ndarray
    sizes: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray


def _slot(code: np.ndarray, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((code * np.uint32(2654435761)) >> np.uint32(32 - (slots - 1).bit_length())).astype(np.int32)


def lexicon_slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (span_crc32(data, starts, ends) % np.uint32(LEXICON)).astype(np.int32)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
    sizes = ends - starts
    heads = np.cumsum(sizes) - sizes
    tails = heads + sizes - 1
    own = np.zeros(0, np.uint32)
    if len(starts):  # the words' own bytes, one after the other
        room = np.zeros(int(ends[-1] - starts[0]) + 1, np.int8)
        room[starts - starts[0]] += 1
        room[ends - starts[0]] -= 1
        own = data[starts[0]: ends[-1]][np.cumsum(room[:-1], dtype=np.int8).astype(bool)].astype(np.uint32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[heads], after[tails] = 0, 0
    prefix, suffix = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32)
    for j in range(4):
        has = np.flatnonzero(sizes > j)
        prefix[has] |= own[heads[has] + j] << np.uint32(8 * j)
        suffix[has] |= own[tails[has] - j] << np.uint32(8 * j)
    return Words(_slot(before << np.uint32(16) | own << np.uint32(8) | after, NGRAMS), heads, sizes, _slot(prefix, AFFIXES), _slot(suffix, AFFIXES),
                 lexicon_slots(data, starts, ends))


@dataclass
class Model:
    """Weights by slot and language; ``lexicon`` holds log shares, ``counts`` their counts. No languages: nothing was learnt."""

    langs: list[str]
    trigrams: np.ndarray
    prefixes: np.ndarray
    suffixes: np.ndarray
    lexicon: np.ndarray
    trust: np.ndarray  # weight of the lexicon score
    moves: np.ndarray  # transition scores, from row to column

    def emissions(self, words: Words, lexicon: np.ndarray | None = None) -> np.ndarray:
        """Scores of every word for every language."""
        if not len(words.sizes):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.trigrams[words.trigrams], words.heads, axis=0)
        out += self.prefixes[words.prefix] + self.suffixes[words.suffix]
        out += self.trust * (self.lexicon[words.lexicon] if lexicon is None else lexicon)
        return out


def log_shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of each language in a slot, against what the languages' sizes alone would give."""
    rate = (counts + 0.1) / (totals + 0.1 * LEXICON)
    return np.log(rate / rate.sum(-1, keepdims=True) * counts.shape[-1]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x /= x.sum(-1, keepdims=True)
    return x


def marginals(scores: np.ndarray, firsts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of every language for every word, by forward-backward over each text (words ``firsts[i]`` to ``firsts[i + 1]``).

    A text starts from no language in particular: every language is as likely before its first word.
    """
    n, k = scores.shape
    out = np.zeros_like(scores, np.float64)
    if not n:
        return out
    step = np.exp(moves - moves.max()).astype(np.float64)
    psi = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30)).astype(np.float64)
    lengths = np.diff(firsts)
    chunks = -(-lengths // CHUNK)
    text = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = firsts[:-1][text] + nth * CHUNK
    size = np.minimum(firsts[1:][text] - start, CHUNK)
    order = np.argsort(-size, kind="stable")  # a step then works on the first chunks only
    start, size, text, nth = start[order], size[order], text[order], nth[order]
    alive = np.searchsorted(-size, -np.arange(1, CHUNK + 1), "right")  # chunks that have a word at each step
    enter, leave = np.full((len(text), k), 1 / k), np.full((len(text), k), 1 / k)
    if (chunks > 1).any():
        many = chunks[text] > 1  # only their chunks need transfer matrices
        at = np.flatnonzero(many)
        moved = np.broadcast_to(np.eye(k), (len(at), k, k)).copy()
        for t in range(CHUNK):
            m = int(np.searchsorted(at, alive[t]))
            if not m:
                break
            now = (moved[:m].reshape(-1, k) @ step).reshape(m, k, k) * psi[start[at[:m]] + t][:, None, :]
            moved[:m] = now / now.sum((1, 2), keepdims=True) if t % RESCALE == 0 else now
        by_nth = np.lexsort((text[at], nth[at]))
        rounds = np.split(by_nth, np.flatnonzero(np.diff(nth[at][by_nth])) + 1)
        a = np.full((len(lengths), k), 1 / k)
        for r in rounds:
            enter[at[r]] = a[text[at[r]]]
            a[text[at[r]]] = _unit(np.einsum("ck,ckl->cl", enter[at[r]], moved[r]))
        b = np.full((len(lengths), k), 1 / k)
        for r in reversed(rounds):
            leave[at[r]] = b[text[at[r]]]
            b[text[at[r]]] = _unit(np.einsum("ckl,cl->ck", moved[r], leave[at[r]]))
    forward = []
    for t in range(CHUNK):
        m = int(alive[t])
        if not m:
            break
        enter = (enter[:m] @ step) * psi[start[:m] + t]
        forward.append(_unit(enter) if t % RESCALE == 0 else enter)
    for t in reversed(range(len(forward))):
        m = len(forward[t])
        out[start[:m] + t] = _unit(forward[t] * leave[:m])
        leave[:m] = (leave[:m] * psi[start[:m] + t]) @ step.T
        if t % RESCALE == 0:
            _unit(leave[:m])
    return out


def train_chain(segments: list[tuple[int, str]], langs: list[str], counts: np.ndarray, seed: int = 5, epochs: int = 4) -> Model:
    """AdaGrad on the likelihood of labelled sequences: segments, and joined halves of two segments of different languages.

    The lexicon leaves the word itself out of its slot's count, as a new text's word would not be in it.
    """
    k = len(langs)
    totals = counts.sum(0)
    zeros = lambda n: np.zeros((n, k), np.float32)
    model = Model(langs, zeros(NGRAMS), zeros(AFFIXES), zeros(AFFIXES), log_shares(counts, totals), np.ones(1, np.float32), np.zeros((k, k)))
    if not segments or k < 2:
        return model
    rng = np.random.default_rng(seed)
    data, offsets = text_bytes(pc.utf8_lower(pa.array([s for _, s in segments])))
    starts, ends, firsts = word_spans(data, offsets, LETTER_BYTES)
    all_words, label = word_features(data, starts, ends), np.array([x for x, _ in segments])
    word_label = np.repeat(label, np.diff(firsts))
    weights = [model.trigrams, model.prefixes, model.suffixes, model.trust, model.moves]
    squares = [np.full(w.shape, 1e-6, np.float64) for w in weights]
    for _ in range(epochs):
        order, other = rng.permutation(len(segments)), rng.permutation(len(segments))
        runs = []
        for i, j in zip(order.tolist(), other.tolist(), strict=True):
            a, b, c, d = firsts[i], firsts[i + 1], firsts[j], firsts[j + 1]
            mixed = label[i] != label[j] and rng.random() < 0.5
            runs.append(np.concatenate([np.arange(a, (a + b + 1) // 2), np.arange((c + d) // 2, d)]) if mixed else np.arange(a, b))
        for at in range(0, len(runs), 64):
            part = runs[at: at + 64]
            ends_ = np.concatenate([[0], np.cumsum([len(r) for r in part])])
            pick = np.concatenate(part).astype(np.int64)
            if not len(pick):
                continue
            sizes = all_words.sizes[pick]
            heads = np.cumsum(sizes) - sizes
            inner = np.arange(int(sizes.sum())) - np.repeat(heads - all_words.heads[pick], sizes)
            words = Words(all_words.trigrams[inner], heads, sizes, all_words.prefix[pick], all_words.suffix[pick], all_words.lexicon[pick])
            gold = word_label[pick]
            own = counts[words.lexicon].astype(np.float64)
            own[np.arange(len(gold)), gold] = np.maximum(own[np.arange(len(gold)), gold] - 1, 0)
            lexicon = log_shares(own, totals)
            scores = model.emissions(words, lexicon)
            p, pairs = _pair_sums(scores, ends_, model.moves)
            g = -p
            g[np.arange(len(gold)), gold] += 1
            seen = np.zeros((k, k))
            inside = np.ones(len(gold), bool)
            inside[ends_[:-1][np.diff(ends_) > 0]] = False
            np.add.at(seen, (gold[np.flatnonzero(inside) - 1], gold[inside]), 1)
            spread = np.repeat(g, sizes, axis=0)
            grads = [_by_slot(words.trigrams, spread, NGRAMS), _by_slot(words.prefix, g, AFFIXES), _by_slot(words.suffix, g, AFFIXES),
                     np.array([(g * lexicon).sum()]), seen - pairs]
            for w, s, d in zip(weights, squares, grads, strict=True):
                d = d / len(part)
                s += d * d
                w += (0.1 * d / np.sqrt(s)).astype(w.dtype)
    return model


def _by_slot(slots: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(slots, values[:, j], n) for j in range(values.shape[1])], 1)


def _pair_sums(scores: np.ndarray, firsts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every word's probabilities, and the expected number of each transition inside the texts."""
    p = marginals(scores, firsts, moves)
    step = np.exp(moves - moves.max())
    psi = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30)).astype(np.float64)
    # P(a, b) of neighbours from forward vectors and the marginal of the second: P(a | b) is forward(a) * step(a, b), scaled.
    k = p.shape[1]
    forward = np.zeros_like(p)
    lengths = np.diff(firsts)
    a = np.full((len(lengths), k), 1 / k)
    for t in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > t)
        a[on] = _unit((a[on] @ step) * psi[firsts[on] + t])
        forward[firsts[on] + t] = a[on]
    inside = np.ones(len(p), bool)
    inside[firsts[:-1][lengths > 0]] = False
    second = np.flatnonzero(inside)
    given = forward[second - 1][:, :, None] * step[None]
    given /= given.sum(1, keepdims=True)
    return p, (given * p[second][:, None, :]).sum(0)


def count_lexicon(texts: DataFrame, langs: list[str]) -> np.ndarray:
    """Words per slot and language over all rows of ``texts(text, lang)``."""
    k = len(langs)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEXICON * k, np.int64)
        codes = pa.array(langs)
        for batch in small(batches, 0):
            data, offsets = text_bytes(pc.utf8_lower(batch.column(0)))
            starts, ends, firsts = word_spans(data, offsets, LETTER_BYTES)
            lang = pc.index_in(batch.column(1), codes).to_numpy()
            total += np.bincount(lexicon_slots(data, starts, ends).astype(np.int64) * k + np.repeat(lang, np.diff(firsts)), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["cell", "n"])

    rows = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # LEXICON rows a language at most
    out = np.zeros(LEXICON * k, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(LEXICON, k)


def fit_languages(docs: DataFrame, trained_on: Column, text_col: str = "text", lang_col: str = "lang", max_segments: int = SEGMENTS) -> Model:
    """Learn from the rows where ``trained_on`` holds and neither text nor language is null.

    The lexicon covers all of them. Weights are fitted on at most ``max_segments`` runs of ``SEGMENT_WORDS`` words, one
    of a text at a place given by its hash; equal texts count once. The languages share that bound evenly.
    """
    rows = docs.where(trained_on).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        none = np.zeros((0, 0), np.float32)
        return Model([], none, none, none, none, np.ones(1, np.float32), np.zeros((0, 0)))
    counts = count_lexicon(rows, langs)
    share = max(1, max_segments // len(langs))
    # Only what may be drawn is cut into words: four times as many texts as are asked for, by hash.
    chance = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, 4 * share / sizes[lang]))])
    drawn = rows.withColumn("h", F.xxhash64("text")).where((F.col("h") / 2.0**64 + 0.5) < F.try_element_at(chance, F.col("lang")))
    words = F.split("text", r"\s+")
    first = F.pmod(F.shiftright("h", 7), F.greatest(F.size("w") - SEGMENT_WORDS + 1, F.lit(1))).cast("int") + 1
    cut = (drawn.withColumn("w", words).select("lang", "h", F.array_join(F.slice("w", first, F.lit(SEGMENT_WORDS)), " ").alias("part"))
           .where(F.length("part").between(1, 100 * SEGMENT_WORDS)).dropDuplicates(["lang", "h"]))
    best = cut.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("nth") <= share)
    found = sorted((r["lang"], r["h"], r["part"]) for r in best.select("lang", "h", "part").collect())  # max_segments rows at most
    return train_chain([(langs.index(a), c) for a, _, c in found], langs, counts)


def _runs(best: np.ndarray, firsts: np.ndarray, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: list[str]) -> pa.Array:
    """Runs of words of one language: where they start and end in the text, in code points."""
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[firsts[:-1][np.diff(firsts) > 0]] = True
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(best)) - 1 if len(head) else head
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = np.searchsorted(firsts, head, "right") - 1
    base = points[offsets[text]]
    runs = pa.StructArray.from_arrays([pa.array((points[starts[head]] - base).astype(np.int32)), pa.array((points[ends[tail]] - base).astype(np.int32)),
                                       pa.array(langs).take(pa.array(best[head]))], names=["start", "end", "lang"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(head, firsts).astype(np.int32)), runs)


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, and with ``runs`` its labelled stretches ``(start, end, lang)`` in code points.

    ``score`` is the expected share of the words in that language; equal shares go to the smaller name. A null text, one
    without a letter, and every text under a model that learnt nothing get ``und``, score 0 and no runs. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("spoken"))
    langs = model.langs
    kind = dict(slim.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang_pred string, score double" + ", runs array<struct<start:int,end:int,lang:string>>" * runs

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*langs, UNKNOWN])
        for batch in small(batches, 1):
            spoken = batch.column(2).to_numpy(zero_copy_only=False) & bool(langs)
            text = pc.utf8_lower(pc.if_else(pa.array(spoken), batch.column(1), pa.scalar("", batch.column(1).type)))
            data, offsets = text_bytes(text)
            starts, ends, firsts = word_spans(data, offsets, LETTER_BYTES)
            p = marginals(_scores(model, data, starts, ends), firsts, model.moves)
            sums = np.concatenate([np.zeros((1, max(len(langs), 1))), np.cumsum(p, 0) if len(p) else np.zeros((0, max(len(langs), 1)))])
            shares = (sums[firsts[1:]] - sums[firsts[:-1]]) / np.maximum(np.diff(firsts), 1)[:, None]
            best = np.where(spoken, shares.argmax(1), len(langs)).astype(np.int32)
            score = np.where(spoken, shares.max(1), 0.0).clip(0, 1)
            out = [batch.column(0), names.take(pa.array(best)), pa.array(score)]
            if runs:
                out.append(_runs(p.argmax(1).astype(np.int32) if len(p) else np.zeros(0, np.int32), firsts, data, offsets, starts, ends, langs))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "runs"][: len(out)])

    return slim.mapInArrow(label, schema)


def _scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """Emissions of all words, worked out for ``piece`` words at a time."""
    parts = [model.emissions(word_features(data, starts[a: a + piece], ends[a: a + piece])) for a in range(0, len(starts), piece)]
    return np.concatenate(parts) if parts else np.zeros((0, max(len(model.langs), 1)), np.float32)
