"""Target-distribution importance resampling: hashed word runs, log gains per bucket, Gumbel top-k.

A feature is a run of consecutive words; its bucket is its CRC-32. The sums come from a position table
(``byte_spans.span_crc32``) over whole batches of texts. Buckets are counted over all rows of both tables and summed before
and after one shuffle; what comes to the driver is one number a bucket. A document's weight is the sum of its features'
gains, whole numbers, so it does not depend on any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.byte_spans import LOWER, gram_spans, joined_words, span_crc32, text_bytes, word_spans
from jobsieve.llm.store import stored
from jobsieve.llm.words import small
from jobsieve.operators.ordering import number_rows

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024


def features(column: pa.Array, n_max: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every length of runs: the buckets of all features, and the number of features before each text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, offsets)
    yield (span_crc32(data, starts, ends) % np.uint32(buckets)).astype(np.int32), firsts
    if n_max > 1:
        data, starts, ends = joined_words(data, starts, ends, firsts)
    for n in range(2, n_max + 1):
        a, b, heads = gram_spans(starts, ends, firsts, n)
        yield (span_crc32(data, a, b) % np.uint32(buckets)).astype(np.int32), heads


def bucket_counts(texts: DataFrame, text_col: str = "text", n_max: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of ``texts``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in small(batches, 0):
            for found, _ in features(batch.column(0), n_max, buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    rows = (texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n"))).toArrow()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of the two distributions, rounded down."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n_max: int = 1) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row."""

    def weights(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for k, (found, heads) in enumerate(features(batch.column(1), n_max, len(gains))):
                sums = np.concatenate([[0], np.cumsum(gains[found])])
                total += np.diff(sums[heads])
                n += np.diff(heads)
                if k == 0:
                    words = np.diff(heads)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(weights, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(ident: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that depends on the seed and the id only; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n_max: int = 1,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)``, a row for every row of ``docs``.

    Drawn are the ``floor(percent * N / 100)`` highest scores of the N rows with at least ``min_words`` words, ranked from 1
    on; equal scores stand by id (null last), rows of one id by weight and number of features. Other rows have no rank. Null
    and empty texts have no features and weight 0; an empty target makes all gains depend on the documents alone; repeated
    rows are rows of their own. Other columns of either table are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, n_max, buckets), bucket_counts(target, target_text, n_max, buckets))
    scored = weigh(docs, gains, id_col, text_col, n_max)
    scored = stored(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance")
    fit = F.col("n_words") >= min_words
    drawn = percent * scored.where(fit).count() // 100
    # The place of a row is last, so that copies of one row can be dealt to several ranges.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), F.col("place")]
    ranked = number_rows(scored.where(fit).withColumn("place", F.monotonically_increasing_id()), order, "rank").drop("place")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
