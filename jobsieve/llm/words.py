"""Words of many texts at once, as flat arrays: what the array operators share inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
CACHE_WORDS = 150_000
PIECE_BYTES = 2 << 20
FILTER_BITS = 27  # at most 16 MB of bits are sent to the tasks, however many hashes there are


def small(batches: Iterable[pa.RecordBatch], column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, a longer text by itself: words are Python objects, and
    those of one batch are held at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // limit
        starts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            yield batch.slice(a, b - a)


def space_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.encode(errors="replace").lower().split() if text else []


class Kept(dict):
    """``fn`` of a word, kept; the store is emptied when it holds ``limit`` words, which changes no result."""

    def __init__(self, fn: Callable, limit: int = CACHE_WORDS):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.fn(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        return x ^ (x >> np.uint64(33))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on, for places that have that many."""
    out = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += mix(words[j: j + len(out)] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
            out *= np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def flat(texts: list[str | None], split: Callable, value: Kept, dtype) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """``(values of all words, ends of the texts, words)``."""
    words = [split(t) for t in texts]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    total = int(ends[-1]) if len(ends) else 0
    look = value.__getitem__
    return np.fromiter((v for ws in words for v in map(look, ws)), dtype, total), ends, words


def hash_filter(hashes: DataFrame, column: str, each: int = 16) -> np.ndarray:
    """Bits of all 64-bit hashes in a column, ``each`` a hash up to the bound. It only spares rows that an exact join drops."""
    bits = max(12, min(FILTER_BITS, (each * hashes.count()).bit_length()))
    low = (1 << bits) - 1
    places = F.explode(F.array(F.col(column).bitwiseAND(F.lit(low)), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(low))))
    rows = (hashes.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy().astype(np.int64)] = rows["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes the bits of ``hash_filter`` may hold."""
    bits = (len(words) * 64).bit_length() - 1
    out = np.ones(len(hashes), bool)
    for shift in (0, 32):
        at = (hashes >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out
