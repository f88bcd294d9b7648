"""First-wins and last-wins reductions, and the guard against one text stored under two ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.text import let, squash
from jobsieve.session import durable

HOT_KEYS = 1000
MIN_GUARD_CHARS = 200  # fixed value: shorter texts are not distinctive


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the earliest (rows without an order come last). Partial aggregation keeps one row per key and input partition, so a
    key holding a third of all rows shuffles like any other."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), order)).alias("_row"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])


def last_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the latest; further columns decide ties."""
    rest = [c for c in df.columns if c not in keys]
    latest = F.struct(*[x for o in order for x in (F.col(o).isNotNull().alias(f"has_{o}"), F.col(o))])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), latest).alias("_row"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])


def dedupe_first(df: DataFrame, on: str = "job_id", seq: str = "seq") -> DataFrame:
    """The first arrival of an id wins. ``on="dedup_key"`` collapses by cluster instead."""
    return first_per_key(df, [on], seq)


def skip_known(df: DataFrame, known: DataFrame, on: str = "job_id") -> DataFrame:
    """Rows whose id is not in ``known`` (exported, turned down, processed or stored)."""
    return df.join(known.select(on), on, "left_anti")


def lookup_hot(left: DataFrame, right: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """Left join on a key that may be badly skewed on the left; ``right`` has one row per key with a row count.

    The ``HOT_KEYS`` most frequent keys are broadcast (a fixed number of rows); every other key holds less
    than 1/HOT_KEYS of the rows and joins by shuffle. Rows already answered are spread by ``spread`` so
    they do not meet in one task.
    """
    values = [c for c in right.columns if c not in (key, count)]
    hot = right.orderBy(F.col(count).desc(), key).limit(HOT_KEYS).select(
        key, F.struct(*values).alias("_hot"))
    cold = right.select(F.col(key).alias("_k"), F.lit(False).alias("_answered"), F.struct(*values).alias("_cold"))
    marked = left.join(F.broadcast(hot), key, "left")
    answered = F.col("_hot").isNotNull()
    probe = marked.withColumn("_answered", answered).withColumn(
        "_k", F.when(answered, F.col(spread).cast(right.schema[key].dataType)).otherwise(F.col(key)))
    joined = probe.join(cold, ["_k", "_answered"], "left")
    return joined.select(
        *left.columns, *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values])


def text_keys(df: DataFrame, text: str = "description", seq: str = "seq") -> DataFrame:
    """``job_id, _seq, _key`` per row, worked out once and written: the digest of its white-space-collapsed text, null for short ones."""
    squashed = squash(F.coalesce(F.col(text), F.lit("")))
    return durable(df.select("job_id", F.col(seq).alias("_seq"), let(
        squashed, lambda t: F.when(F.length(t) >= MIN_GUARD_CHARS, F.sha2(t, 256))).alias("_key")))


def guard_duplicates(df: DataFrame, text: str = "description", seq: str = "seq") -> DataFrame:
    """Add ``owner_id``: the id that first brought this row's text when that is another id, else null.

    Texts are compared by a 256-bit digest of the white-space-collapsed text. The digest is worked out once per row and
    written with the row's id and order; only the few ids that repeat another's text meet the rows again.
    """
    long = text_keys(df, text, seq).where("_key is not null")
    owners = durable(
        long.groupBy("_key").agg(F.min_by("job_id", F.struct(F.col("_seq").isNull(), "_seq")).alias("owner_id"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").drop("_n"))
    repeats = long.join(owners, "_key").where("owner_id <> job_id").groupBy("job_id").agg(F.min("owner_id").alias("owner_id"))
    return df.join(repeats, "job_id", "left")


def split_duplicates(df: DataFrame, text: str = "description", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``; rejects name the id whose text they repeat."""
    guarded = guard_duplicates(df, text, seq)
    kept = guarded.where("owner_id is null").drop("owner_id")
    return kept, guarded.where("owner_id is not null")
