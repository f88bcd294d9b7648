"""Words of a column of texts as spans of one byte buffer, and CRC-32 of spans from a table of positions.

CRC-32 is linear over XOR: a byte adds a value that depends only on the byte and its distance from the end of the span, and
the length adds a constant. So the sums of all spans of a batch are one look-up per byte and one ``bitwise_xor.reduceat``.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 64  # distances in the table; a longer span is folded from blocks of this length
PIECE = 1 << 20  # bytes whose look-ups are held at once

# Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased: digits, a-z, and all bytes of other characters.
WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none) and where each begins, with the end last."""
    flat = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64, len(flat) + 1 + flat.offset)[flat.offset:] if len(flat) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, none of which reaches over two texts, and the number of words before each text."""
    mask = word_bytes[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = mask[cuts]
    last[cuts - 1] = mask[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


@cache
def position_table() -> np.ndarray:
    """``[distance from the end, byte]``: what the byte adds to the sum of its span."""
    zero = zlib.crc32(b"\0")
    out = np.zeros((BLOCK, 256), np.uint32)
    out[0] = [zlib.crc32(bytes([b])) ^ zero for b in range(256)]
    for d in range(1, BLOCK):
        out[d] = out[0][out[d - 1] & 255] ^ (out[d - 1] >> np.uint32(8))
    return out


@cache
def length_constant(size: int) -> int:
    return zlib.crc32(bytes(size))


def _shift_tables(shift: list[np.ndarray] | None) -> list[np.ndarray]:
    """By byte of a sum, what it becomes after ``BLOCK`` more bytes, or after twice as many as ``shift`` stands for."""
    if shift is not None:
        return [_shifted(t, shift) for t in shift]
    table = position_table()
    out = []
    for j in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        for _ in range(BLOCK):
            x = table[0][x & 255] ^ (x >> np.uint32(8))
        out.append(x)
    return out


def _shifted(x: np.ndarray, shift: list[np.ndarray]) -> np.ndarray:
    return shift[0][x & 255] ^ shift[1][x >> np.uint32(8) & 255] ^ shift[2][x >> np.uint32(16) & 255] ^ shift[3][x >> np.uint32(24)]


def _short(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the positions of spans of 1 to ``BLOCK`` bytes, without the length's constant."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint32)
    table = position_table().ravel()
    total = np.cumsum(sizes)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PIECE, "right")))
        own = sizes[a:b]
        heads = np.cumsum(own) - own
        away = np.repeat((heads + own - 1).astype(np.int32), own) - np.arange(int(own.sum()), dtype=np.int32)  # to the end of the span
        at = np.repeat(ends[a:b] - 1, own) - away
        out[a:b] = np.bitwise_xor.reduceat(table[away * 256 + data[at]], heads)
        a = b
    return out


def span_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span ``data[start:end]``, of any length; equal to ``zlib.crc32``."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint32)
    near = np.flatnonzero((sizes > 0) & (sizes <= BLOCK))
    out[near] = _short(data, starts[near], ends[near])
    far = np.flatnonzero(sizes > BLOCK)
    if len(far):
        # Blocks are counted from the end, so that only the first of a span may be short.
        counts = -(-sizes[far] // BLOCK)
        of = np.repeat(np.arange(len(far)), counts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        end = ends[far][of] - k * BLOCK
        values = _short(data, np.maximum(end - BLOCK, starts[far][of]), end)
        shift = None
        while counts.max() > 1:  # neighbours are folded, then neighbours of those: a span of n blocks takes log2(n) rounds
            shift = _shift_tables(shift)
            after = (counts + 1) // 2
            heads = np.cumsum(after) - after
            folded = np.zeros(int(after.sum()), np.uint32)
            even = k % 2 == 0
            folded[heads[of[even]] + k[even] // 2] = values[even]
            folded[heads[of[~even]] + k[~even] // 2] ^= _shifted(values[~even], shift)
            counts, values = after, folded
            of = np.repeat(np.arange(len(far)), counts)
            k = np.arange(len(of)) - np.repeat(heads, counts)
        out[far] = values
    lengths, which = np.unique(sizes, return_inverse=True)
    return out ^ np.array([length_constant(int(n)) for n in lengths], np.uint32)[which] if len(out) else out


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words alone, joined by one space inside each text: the buffer, and the words' starts and ends in it."""
    inner = np.ones(len(starts), bool)
    inner[firsts[1:][firsts[1:] > 0] - 1] = False  # the last word of a text has no space after it
    sizes = ends - starts
    room = sizes + inner
    heads = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint8)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(heads, sizes) + inside] = data[np.repeat(starts, sizes) + inside]
    return out, heads, heads + sizes


def gram_spans(starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of ``n`` consecutive words of one text, and their number before each text."""
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    fits = np.arange(len(starts)) + n <= firsts[1:][text]
    at = np.flatnonzero(fits)
    return starts[at], ends[at + n - 1], np.searchsorted(at, firsts)
