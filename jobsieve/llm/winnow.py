"""Benchmark decontamination by winnowing.

In every window of ``span`` words the smallest hash of its ``gram``-word grams is the window's fingerprint. Equal windows
have equal fingerprints, so whatever a document and an item share over ``span`` words or more is found where their
fingerprints meet; a hit is checked on the words themselves and extended over its neighbours to the whole shared span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.store import stored
from jobsieve.llm.words import Kept, flat, gram_hashes, hash_filter, may_hold, small

SPAN = 10
GRAM = 6

# ASCII letters (lower-cased) and digits and everything beyond ASCII are word characters; all else parts words.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def fold_words(text: str | None) -> list[bytes]:
    return text.encode(errors="replace").translate(_FOLD).split() if text else []


def _window_minima(words: np.ndarray, n: int, gram: int) -> np.ndarray:
    """Fingerprint of the ``n`` words from each place on."""
    grams = gram_hashes(words, min(gram, n))
    width = n - min(gram, n) + 1
    out = grams[: max(len(words) - n + 1, 0)].copy()
    for j in range(1, width):
        np.minimum(out, grams[j: j + len(out)], out=out)
    return out


HITS = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("fp", pa.int64()), ("window", pa.string())]))


def _scanner(lengths: list[int], gram: int, bits: np.ndarray | None, whole_short: int | None):
    """Batches of (id, text) to (id, n_words, hits). ``bits``: keep fingerprints that may be an item's. ``whole_short``: the
    span of items, of which a shorter one is a window by itself."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Kept(xxhash.xxh64_intdigest)
        for batch in small(batches, 1):
            values, ends, words = flat(batch.column(1).to_pylist(), fold_words, hashes, np.uint64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sizes = ends - starts
            hits: list[list[tuple]] = [[] for _ in words]
            for n in lengths:
                fp = _window_minima(values, n, gram)
                at = np.flatnonzero(may_hold(bits, fp)) if bits is not None else np.arange(len(fp))
                doc = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[doc]
                if whole_short is not None:
                    inside &= (sizes[doc] == n) | (n == whole_short)
                for p, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                    i = p - int(starts[d])
                    hits[d].append((i, n, int(fp[p].astype(np.int64)), b" ".join(words[d][i: i + n]).decode(errors="replace")))
            rows = [[dict(zip(("pos", "n", "fp", "window"), h, strict=True)) for h in x] for x in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, HITS)], names=["id", "n_words", "hits"])

    return scan


def _scan(df: DataFrame, id_col: str, text_col: str, scanner) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(scanner, f"id {kind}, n_words long, hits array<struct<pos:int,n:int,fp:bigint,window:string>>")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per document row: ``uid, doc_id, n_words, n_hit, n_items, items, spans, contaminated``.

    ``spans`` are the maximal runs of hit words as ``(start, end)`` word places, ``items`` the item ids as sorted strings. An
    item shorter than ``span`` is one window; one without words matches nothing. Null text has no words, a null item id
    counts as the empty string, repeated items and ids count once, repeated documents get a row each. Extra columns are
    ignored. A window of an item is looked for in every document, whatever the item's or document's number of copies.
    """
    windows = stored(
        _scan(items, item_id, item_text, _scanner(list(range(1, span + 1)), gram, None, span))
        .select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), F.explode("hits").alias("h"))
        .select("item", "h.n", "h.fp", "h.window").distinct(), "item-windows")
    distinct = stored(windows.select("n", "fp", "window").distinct(), "windows")
    lengths = sorted(r["n"] for r in distinct.select("n").distinct().collect())  # at most ``span`` numbers
    bits = hash_filter(distinct, "fp")
    scanned = stored(_scan(docs, doc_id, doc_text, _scanner(lengths, gram, bits, None))
                     .select(F.monotonically_increasing_id().alias("uid"), F.col("id").alias("doc_id"), "n_words", "hits"), "scanned")
    met = (scanned.select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
           .join(distinct.select("fp", "window"), ["fp", "window"], "left_semi"))
    met = stored(met, "window-hits")
    start = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def extend(spans, h):
        last = F.element_at(spans, -1)
        end = h["pos"] + h["n"]
        grown = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))))
        return F.when(h["pos"] <= last["end"], grown).otherwise(F.concat(spans, F.array(F.struct(h["pos"].alias("start"), end.alias("end")))))

    spans = met.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("places"))
    spans = spans.select("uid", F.aggregate("places", F.array(start), extend, lambda s: F.slice(s, 2, F.size(s))).alias("spans"))
    found = (met.select("uid", "fp", "window").distinct().join(windows.select("fp", "window", "item"), ["fp", "window"])
             .select("uid", "item").distinct()
             .groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items")))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    out = scanned.drop("hits").join(spans, "uid", "left").join(found, "uid", "left")
    out = out.withColumns({"spans": F.coalesce("spans", nothing), "items": F.coalesce("items", F.array().cast("array<string>"))})
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("uid", "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
                      (hit > 0).alias("contaminated"))
