"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-sorted by id and encoded with a public tokenizer; each task writes the raw ids of its range to one
shard. Document keys are then dealt into buckets of bounded size, and each bucket gets a minimal perfect hash function
(levels of collision-free bits, after Limasset et al., 2017) that maps a key to a slot with a stored fingerprint, the
shard, the offset and the number of ids: one access finds a document's ids, wherever they are.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.llm.store import open_fs, shared_dir, stored
from jobsieve.llm.words import small

END_ID = 2
BUCKET_KEYS = 65_536
CACHE_UNITS = 250_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
_EVEN = re.compile(r"(?= )|(?=\n)|(?<=\n)")
_LETTER_MARK = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([!-&(-/:;=?@])"  # a token never goes on from a letter to these marks
# The characters that count as white space in the vocabulary's pattern, but for space and line break, and U+0000.
_OTHER = "\\x00\t\x0b\x0c\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = f"[{_OTHER}]|^[ \n]|[ \n][ \n]|[ \n]$"


class Encoder:
    """Ids of whole texts, equal to encoding each text at once, with the ids of frequent pieces kept.

    The byte-level pre-tokenizer never lets a token cross the place before a single space, or around a single line
    break, that stands between two other characters, nor from a letter to a mark; texts are cut there by Arrow, each different piece of
    a batch is encoded once while it is kept, and a batch's ids are gathered from the kept ones. Beyond ``cache`` pieces, those that
    only one batch had go. A mark such as <|endoftext|> in a text has its own id, as by
    the plain library call; it holds no white space, so it stays whole.
    """

    def __init__(self, path: str, cache: int = CACHE_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4"
        self.limit = cache
        self.newline = self._ids("\n")
        self._forget()

    def _forget(self) -> None:
        """Kept pieces: ``place`` numbers them, piece i is ``pool[start[i]: start[i + 1]]``, and ``uses[i]`` batches had it."""
        self.place: dict[str, int] = {}
        self.pool, self.start, self.uses = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _gather(self, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at ``at``, one after the other, and where each piece ends."""
        sizes = np.diff(start)[at]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(start[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _thin(self) -> None:
        """Only pieces that several batches had since the last time stay; none do if these are many."""
        stays = np.flatnonzero(self.uses > 1)
        if 2 * len(stays) > self.limit:
            return self._forget()
        names = list(self.place)  # in the order of their places
        self.pool, ends = self._gather(stays, self.start)
        self.start, self.uses = np.append(0, ends), np.zeros(len(stays), np.int32)
        self.place = {names[i]: k for k, i in enumerate(stays.tolist())}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _many(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces without line breaks: one text with a line break between them, which is a token of its own there."""
        out: list[np.ndarray] = []
        for i in range(0, len(pieces), 20_000):
            part = pieces[i: i + 20_000]
            ids = self._ids("\n".join(part))
            at = np.flatnonzero(ids == self.newline[0]) if len(self.newline) == 1 else np.zeros(0, np.int64)
            if len(at) == len(part) - 1:
                bounds = [0, *(at + 1).tolist(), len(ids) + 1]
                out.extend(ids[a: b - 1] for a, b in zip(bounds, bounds[1:], strict=False))
            else:
                out.extend(map(self._ids, part))
        return out

    def _learn(self, new: list[str]) -> None:
        plain = [p for p in new if "\n" not in p]
        other = [p for p in new if "\n" in p]
        ids = self._many(plain) + [self._ids(p) for p in other]
        self.place.update(zip(plain + other, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        self.pool = np.concatenate([self.pool, *ids])
        self.uses = np.append(self.uses, np.zeros(len(new), np.int32))

    @staticmethod
    def _cut(texts: pa.Array) -> pa.ListArray:
        """Pieces of every text. U+0000 marks the places; texts that hold it, other white space or several in a row are cut by ``_CUT``."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            lists = texts.to_pylist()
            return pa.array([_CUT.split(t) if o else _EVEN.split(t) for t, o in zip(lists, odd.tolist(), strict=True)], pa.list_(pa.string()))
        marked = pc.replace_substring_regex(pc.replace_substring(texts, " ", "\0 "), _LETTER_MARK, "\\1\0\\2")
        return pc.split_pattern(pc.replace_substring(marked, "\n", "\0\n\0"), "\0")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > self.limit:
            self._thin()
        lists = self._cut(pa.array(texts, pa.string()))
        codes = lists.flatten().dictionary_encode()
        pieces = codes.dictionary.to_pylist()
        new = [p for p in pieces if p and p not in self.place]
        if new:
            self._learn(new)
        empty = len(self.place)  # stands for the one piece of an empty text
        at = np.fromiter((self.place[p] if p else empty for p in pieces), np.int64, len(pieces))
        self.uses[at[at < empty]] += 1
        ids, ends = self._gather(at[codes.indices.to_numpy()], np.append(self.start, self.start[-1]))
        bounds = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(bounds.tolist(), bounds.tolist()[1:], strict=False)]


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


MANIFEST = "part int, nth long, again long, shard string, offset long, n_tokens long"


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        files, root = open_fs(folder)
        shard = f"ids-{part:06d}-{uuid.uuid4().hex}.bin"  # a fresh name per attempt
        end = np.array([end_id], enc.dtype).tobytes()
        nth, again, last, at = 0, 0, (), 0
        with files.open_output_stream(f"{root}/{shard}", compression=None) as out:
            for batch in small(batches, 1):
                ids, rows = batch.column(0).to_pylist(), []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for i, data in zip(ids, enc.encode(texts), strict=True):
                    out.write(data.tobytes() + end)
                    again = again + 1 if last == (i,) else 0
                    n, last = len(data) + 1, (i,)
                    rows.append((part, nth, again, shard, at, n))
                    nth, at = nth + 1, at + n
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "part", "nth", "again", "shard", "offset", "n_tokens"])

    return write


# --- minimal perfect hashing ---------------------------------------------------------------------------------------

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LEVELS = 48


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + _STEP * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def build_mph(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bits per level (two places a key), and the hashes no level could place, as keys whose 64-bit hashes are equal."""
    levels, left = [], hashes
    while len(left) and len(levels) < _LEVELS:
        size = 2 * len(left)
        at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels, left


def slots(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Slot of each hash, -1 if no level holds it."""
    out, base = np.full(len(hashes), -1, np.int64), 0
    for k, bits in enumerate(levels):
        ranks = np.cumsum(bits) - 1
        at = (_mix(hashes, k) % np.uint64(len(bits))).astype(np.int64)
        hit = (out < 0) & bits[at]
        out[hit] = base + ranks[at[hit]]
        base += int(bits.sum())
    return out


def _pack(meta: dict, arrays: dict[str, np.ndarray]) -> bytes:
    meta["arrays"] = [[k, a.dtype.str, len(a)] for k, a in arrays.items()]
    head = json.dumps(meta).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() for a in arrays.values())


def _unpack(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    n = int.from_bytes(data[:8], "little")
    meta, at, arrays = json.loads(data[8: 8 + n]), 8 + n, {}
    for k, kind, size in meta["arrays"]:
        arrays[k] = np.frombuffer(data, kind, size, at)
        at += arrays[k].nbytes
    return meta, arrays


def _index_writer(folder: str):
    def write(keys: pd.DataFrame) -> pd.DataFrame:
        files, root = open_fs(folder)
        h = keys["h"].to_numpy(np.int64).view(np.uint64)
        levels, _ = build_mph(h)
        slot = slots(levels, h)
        # Keys that share a 64-bit hash are found in no level: they follow, ordered, and are told apart by their text.
        rest = np.flatnonzero(slot < 0)
        slot[rest] = len(h) - len(rest) + np.arange(len(rest))
        put = np.argsort(slot)
        shards = sorted(set(keys["shard"]))
        arrays = {"sizes": np.array([len(x) for x in levels], "<i8"),
                  "bits": np.packbits(np.concatenate(levels)) if levels else np.array([], np.uint8),
                  "fingerprint": keys["fp"].to_numpy("<i4")[put], "shard": keys["shard"].map({s: i for i, s in enumerate(shards)}).to_numpy("<u4")[put],
                  "offset": keys["offset"].to_numpy("<u8")[put], "n_tokens": keys["n_tokens"].to_numpy("<u8")[put]}
        bucket = int(keys["bucket"].iloc[0])
        name = f"mph-{bucket:06d}-{uuid.uuid4().hex}.idx"
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(_pack({"shards": shards, "rest": keys["key"].iloc[rest].tolist()}, arrays))
        return pd.DataFrame({"bucket": [bucket], "index_file": [name], "n_keys": [len(h)]})

    return write


def _finder(folder: str, columns: list[str]):
    def find(keys: pd.DataFrame) -> pd.DataFrame:
        files, root = open_fs(folder)
        with files.open_input_file(f"{root}/{keys['index_file'].iloc[0]}") as source:
            meta, a = _unpack(source.read())
        bits, levels, at = np.unpackbits(a["bits"]).astype(bool), [], 0
        for n in a["sizes"].tolist():
            levels.append(bits[at: at + n])
            at += n
        slot = slots(levels, keys["h"].to_numpy(np.int64).view(np.uint64))
        rest = {k: len(a["offset"]) - len(meta["rest"]) + i for i, k in enumerate(meta["rest"])}
        slot = np.array([rest.get(k, s) for k, s in zip(keys["key"], slot, strict=True)], np.int64) if rest else slot
        safe = np.maximum(slot, 0)
        good = (slot >= 0) & (a["fingerprint"][safe] == keys["fp"].to_numpy(np.int32)) if len(a["offset"]) else slot >= 0
        out = keys[good].copy()
        safe = safe[good]
        out["shard"] = np.array(meta["shards"], object)[a["shard"][safe]]
        out["offset"], out["n_tokens"] = a["offset"][safe].astype(np.int64), a["n_tokens"][safe].astype(np.int64)
        return out[[*columns, "key", "shard", "offset", "n_tokens"]]

    return find


def _id_reader(folder: str, dtype: str, columns: list[str], payload: bool):
    width = np.dtype(dtype).itemsize

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        files, root = open_fs(folder)
        rows = rows.sort_values("offset")
        crcs, texts = [], []
        with files.open_input_file(f"{root}/{rows['shard'].iloc[0]}") as source:
            for offset, n in zip(rows["offset"], rows["n_tokens"], strict=True):
                source.seek(offset * width)
                ids = np.frombuffer(source.read(n * width), dtype).astype("<u4")
                crcs.append(zlib.crc32(ids.tobytes()))
                if payload:
                    texts.append(ids.astype(np.int64))
        rows = rows.assign(ids_crc32=crcs, **({"ids": texts} if payload else {}))
        return rows[[*columns, "key", "shard", "offset", "n_tokens", "ids_crc32", *["ids"] * payload]]

    return read


@dataclass
class TokenStore:
    """Where the files are. ``manifest`` has a row per document: ``doc_id, key, part, nth, shard``; ``parts`` a row per shard
    with the number of ids before it; ``buckets`` a row per index file."""

    folder: str
    dtype: str
    manifest: DataFrame
    parts: DataFrame
    buckets: DataFrame
    n_buckets: int

    def find(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose ``key`` the index holds, with ``shard, offset, n_tokens``. Keep its keys distinct: a group is a bucket."""
        keep = [c for c in wanted.columns if c != "key"]
        rows = _hashed(wanted, self.n_buckets).join(self.buckets.select("bucket", "index_file"), "bucket")
        kinds = dict(wanted.dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "key string, shard string, offset long, n_tokens long"])
        return rows.groupBy("bucket").applyInPandas(_finder(self.folder, keep), schema)

    def read(self, located: DataFrame, payload: bool = False) -> DataFrame:
        """``located`` with ``ids_crc32`` (over the ids as unsigned 32-bit) and, if wanted, the ``ids``. A group is a shard."""
        keep = [c for c in located.columns if c not in ("key", "shard", "offset", "n_tokens")]
        kinds = dict(located.dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "key string, shard string, offset long, n_tokens long, ids_crc32 long"])
        return located.groupBy("shard").applyInPandas(_id_reader(self.folder, self.dtype, keep, payload), schema + ", ids array<bigint>" * payload)


def _hashed(keys: DataFrame, n_buckets: int) -> DataFrame:
    return keys.withColumns({"h": F.xxhash64("key"), "fp": F.hash("key"), "bucket": F.pmod(F.xxhash64(F.lit("bucket"), "key"), F.lit(n_buckets)).cast("int")})


def write_token_store(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                      bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Encode every text, append ``end_id``, write shards in ascending id order (null last) and their index.

    Null text is empty and has the end id only. A document's key is its id as text, ``null`` for null; of rows that
    repeat an id the first in file order has that key, the others ``id#part.place``. Extra columns are ignored. An
    empty table gives one empty shard at most, and an index without buckets.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The text's hash and a row number split an id that repeats very often; such rows may stand in any order.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2])
    manifest = stored(laid.mapInArrow(_writer(folder, tokenizer, end_id), f"doc_id {kind}, {MANIFEST}"), "token-manifest")
    in_order = Window.orderBy("part")
    parts = stored(
        manifest.groupBy("part", "shard").agg(F.sum("n_tokens").alias("ids"), F.min_by("doc_id", "nth").alias("first_id"), F.max_by("doc_id", "nth").alias("last_id"))
        .select("part", "shard", (F.sum("ids").over(in_order) - F.col("ids")).alias("part_start"), "first_id",
                (F.lag(F.lit(True)).over(in_order).isNotNull() & F.lag("last_id").over(in_order).eqNullSafe(F.col("first_id"))).alias("goes_on")), "token-parts")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    later = (F.col("again") > 0) | (F.col("goes_on") & F.col("doc_id").eqNullSafe(F.col("first_id")))
    keyed = manifest.join(parts.select("part", "first_id", "goes_on"), "part").select(
        "doc_id", F.when(later, F.concat(name, F.lit("#"), F.col("part"), F.lit("."), F.col("nth"))).otherwise(name).alias("key"),
        "part", "nth", "shard", "offset", "n_tokens")
    n_buckets = max(1, math.ceil(manifest.count() / bucket_keys))
    buckets = stored(_hashed(keyed, n_buckets).groupBy("bucket").applyInPandas(_index_writer(folder), "bucket int, index_file string, n_keys long"), "token-index")
    return TokenStore(folder, encoder(tokenizer).dtype, keyed.drop("offset", "n_tokens"), parts, buckets, n_buckets)


def read_token_store(store: TokenStore) -> DataFrame:
    """Every document looked up by its key and read back: ``doc_id, start, n_tokens, ids_crc32``."""
    read = store.read(store.find(store.manifest.select("doc_id", "key")))
    return (read.join(store.parts.select("shard", "part_start"), "shard")
            .select("doc_id", (F.col("part_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))
