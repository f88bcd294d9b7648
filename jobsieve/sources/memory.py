"""Stored postings and the small memory tables (history, verdicts, plans, log, runs).

Memory tables are lists of written folders (see ``snapshots``) read as "newest row per key": an update costs the size of the
update, a delete is a tombstone row, and a reader sees one state of the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.operators.dedupe import dedupe_first, last_per_key
from jobsieve.schema import POSTING, as_postings, ddl
from jobsieve.sources import snapshots
from jobsieve.sources.snapshots import Snapshot


STORE_BUCKETS = 64  # fixed for a store's life: a posting lies in the folder of its id's hash
LOOKUP_IDS = 100  # a batch of no more ids asks for each by name, so that the files' Bloom filters can pass row groups by


def bucket(job_id: Column | str) -> Column:
    """The folder of an id; rows without an id share one."""
    return F.pmod(F.xxhash64(job_id), F.lit(STORE_BUCKETS)).cast("int")


def bloom_filter(column: str) -> dict[str, str]:
    """Options for a Bloom filter in each file, the smallest that fits its rows: of 15 sizes, halved from 1 MB. By default each has 1 MB."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", "parquet.bloom.filter.adaptive.enabled": "true",
            f"parquet.bloom.filter.candidates.number#{column}": "15"}


def _layout(spark: SparkSession, path: str, *folders: str) -> DataFrame:
    """Rows of the whole store, or of some of its folders."""
    reader = spark.read.schema(ddl({**POSTING, "bucket": "int", "write": "string"})).option("basePath", path)
    return reader.parquet(*(folders or [path]))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return _layout(spark, path).select(*POSTING)


def stored_ids(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """Ids in the store; with ``buckets`` only their folders are listed and opened."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "job_id string")
    if buckets is None:
        return _layout(spark, path).select("job_id")
    folders = [f for f in (f"{path}/bucket={b}" for b in buckets) if _exists(spark, f)]
    return _layout(spark, path, *folders).select("job_id") if folders else spark.createDataFrame([], "job_id string")


def write_postings(rows: DataFrame, path: str, token: str) -> None:
    """Add ``rows`` to the store under a write's token. The same rows under the same token again replace themselves.

    The files carry Bloom filters of the ids. A batch is dealt by folder in pieces of even size, however its ids and sources are spread.
    Without adaptive execution, as in a stream with state, Spark drops that hint; a folder's rows then meet in one task, or every task
    would write a file into each folder.
    """
    dealt = rows.withColumn("bucket", bucket("job_id")).withColumn("write", F.lit(token))
    adaptive = rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    dealt = dealt.hint("rebalance", "bucket", "source") if adaptive else dealt.repartition("bucket", "source")
    (dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**bloom_filter("job_id"))
     .partitionBy("bucket", "source", "write").parquet(path))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).limit(1)
        return True
    except Exception as e:  # the path not being there yet is the only expected reason
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def append_postings(spark: SparkSession, incoming: DataFrame, path: str, token: str | None = None) -> None:
    """Store postings whose id is not stored yet; within the batch the first arrival wins.

    Of the store only the id column is read, and only in the folders that the batch's ids hash to. A replayed batch finds its
    own ids stored and adds nothing.
    """
    batch = dedupe_first(as_postings(incoming)).persist()
    touched = [r["b"] for r in batch.select(bucket("job_id").alias("b")).distinct().collect()]  # at most STORE_BUCKETS
    known = stored_ids(spark, path, touched)
    few = [r["job_id"] for r in batch.select("job_id").limit(LOOKUP_IDS + 1).collect()]
    if 0 < len(few) <= LOOKUP_IDS:
        known = known.where(reduce(lambda a, b: a | b, (F.col("job_id").eqNullSafe(x) if x is None else F.col("job_id") == x for x in few)))
    # Look the batch's ids up in the store, not the other way round: Spark can then broadcast the batch
    # when its measured size is small, and the store's ids are only streamed past it. A row without an id is an id of its own.
    same = F.col("job_id").eqNullSafe(F.col("known"))
    met = known.select(F.col("job_id").alias("known")).join(batch.select("job_id"), same, "left_semi").distinct()
    write_postings(batch.join(met, same, "left_anti"), path, token or uuid.uuid4().hex)
    batch.unpersist()


def mark_exported(ids: DataFrame, at: str | None = None) -> DataFrame:
    """History rows for a set of exported ids."""
    when = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    return ids.select("job_id").distinct().withColumn("exported_at", when)


COMPACT_AFTER = 32  # writes of a memory table; the next one folds them into one


def upsert_memory(rows: DataFrame, path: str, stream: str | None = None, batch: int = 0) -> None:
    """Append rows; readers pick the newest per key. A stream's batch that is in the table already changes nothing."""
    _add(rows.withColumn("_deleted", F.lit(False)), path, stream, batch)


def _add(rows: DataFrame, path: str, stream: str | None = None, batch: int = 0) -> None:
    spark, write = rows.sparkSession, uuid.uuid4().hex
    is_old = lambda s: stream is not None and s.applied.get(stream, -1) >= batch
    if is_old(snapshots.current(spark, path)):
        return
    rows.write.parquet(f"{path}/{write}")

    def named(s: Snapshot) -> Snapshot | None:
        return None if is_old(s) else Snapshot(writes=[*s.writes, write], applied=s.applied | ({stream: batch} if stream is not None else {}))

    snapshots.commit(spark, path, named)


def forget(ids: DataFrame, path: str, schema: dict[str, str], key: str, at: str, when: str | None = None) -> None:
    """Tombstones for some keys (pass every key to clear the table)."""
    stamp = F.lit(when).cast("timestamp") if when else F.current_timestamp()
    cols = [
        (F.col(c) if c == key else stamp if c == at else F.lit(None)).cast(kind).alias(c)
        for c, kind in schema.items()
    ]
    _add(ids.select(*cols, F.lit(True).alias("_deleted")), path)


def read_memory(spark: SparkSession, path: str, schema: dict[str, str], key: str, at: str, version: int | None = None) -> DataFrame:
    """Newest row per key, tombstoned keys left out. The rows are of one state of the table: the newest when this is called, or ``version``."""
    rows = _rows(spark, path, snapshots.current(spark, path, version).writes, schema)
    return newest(rows, key, at).where("not _deleted").select(*schema)


def _rows(spark: SparkSession, path: str, writes: Sequence[str], schema: dict[str, str]) -> DataFrame:
    kinds = ddl({**schema, "_deleted": "boolean"})
    return spark.read.schema(kinds).parquet(*(f"{path}/{w}" for w in writes)) if writes else spark.createDataFrame([], kinds)


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row per key. At one time a tombstone wins, then the row whose values sort last, so that every read agrees."""
    ties = [c for c, kind in rows.dtypes if c not in (key, at, "_deleted") and not kind.startswith("map")]
    return last_per_key(rows, [key], at, *(["_deleted"] if "_deleted" in rows.columns else []), *ties)


def compact_memory(spark: SparkSession, path: str, into: str, schema: dict[str, str], key: str, at: str) -> None:
    """Rewrite the live rows to a new folder; the caller switches over to it."""
    upsert_memory(read_memory(spark, path, schema, key, at), into)


def fold_memory(spark: SparkSession, path: str, schema: dict[str, str], key: str, at: str, least: int = 2) -> bool:
    """Fold the table's writes into one with the newest row per key, if there are at least ``least``; false if nothing changed.

    Tombstones stay, so that an older row which comes later stays hidden. Writes that land meanwhile are kept beside the folded one, and of two
    foldings of the same writes the second is left out. Folders that no list names any more stay for readers of older states.
    """
    before = snapshots.current(spark, path)
    if len(before.writes) < least:
        return False
    write = uuid.uuid4().hex
    newest(_rows(spark, path, before.writes, schema), key, at).write.parquet(f"{path}/{write}")

    def folded(s: Snapshot) -> Snapshot | None:
        if not set(before.writes) <= set(s.writes):
            return None
        return Snapshot(writes=[write, *(w for w in s.writes if w not in before.writes)], applied=s.applied)

    return write in snapshots.commit(spark, path, folded).writes
