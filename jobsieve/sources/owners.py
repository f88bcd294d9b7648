"""Which id first brought a text, kept from run to run.

The table holds one claim per text: its 256-bit digest and the id that brought it first. Claims lie in folders by digest, so a batch
opens only those its own digests fall into. A batch claims the digests that nobody owns and puts its claims in place
by the numbered lists of ``snapshots``; a writer that lost the race meets the winner's claims and looks again, so no digest has
two owners, whoever writes at the same time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.operators.dedupe import text_keys
from jobsieve.sources import snapshots
from jobsieve.sources.memory import bloom_filter
from jobsieve.sources.snapshots import Snapshot

FOLDERS = 64  # fixed for a table's life
TRIES = 50
CLAIMS = "digest binary, owner_id string, folder int"


def _folder(digest: Column | str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(FOLDERS)).cast("int")


def read_owners(spark: SparkSession, path: str, version: int | None = None, folders: Sequence[int] | None = None) -> DataFrame:
    """``digest, owner_id`` of one state of the table; with ``folders`` only those are listed as partitions to open."""
    return _claims(spark, path, snapshots.current(spark, path, version).writes, folders)


def _claims(spark: SparkSession, path: str, writes: Sequence[str], folders: Sequence[int] | None) -> DataFrame:
    if not writes:
        return spark.createDataFrame([], CLAIMS).drop("folder")
    rows = spark.read.schema(CLAIMS).option("basePath", path).parquet(*(f"{path}/{w}" for w in writes))
    return (rows if folders is None else rows.where(F.col("folder").isin(*folders))).drop("folder")


def _write(claims: DataFrame, path: str) -> str:
    write = f"write={uuid.uuid4().hex}"
    (claims.withColumn("folder", _folder("digest")).hint("rebalance", "folder").sortWithinPartitions("folder", "digest")
     .write.options(**bloom_filter("digest")).partitionBy("folder").parquet(f"{path}/{write}"))
    return write


def guard_batch(df: DataFrame, path: str, text: str = "description", seq: str = "seq") -> DataFrame:
    """Add ``owner_id`` to a batch: the id that first brought this row's text, in this batch or an earlier one, else null.

    Like ``guard_duplicates``, with the texts of all earlier batches. Within a batch the smallest ``seq`` comes first (null last, then
    the smaller id); across batches the one that claimed first, whatever its ``seq``. A replayed batch finds its own claims
    and gets the same answer. Rows without an id own nothing; short and null texts are not compared; an empty batch claims nothing.
    """
    spark = df.sparkSession
    keys = text_keys(df, text, seq).where("_key is not null and job_id is not null").select("job_id", "_seq", F.unhex("_key").alias("digest"))
    touched = [r["f"] for r in keys.select(_folder("digest").alias("f")).distinct().collect()]  # at most FOLDERS
    firsts = keys.groupBy("digest").agg(F.min_by("job_id", F.struct(F.col("_seq").isNull(), "_seq", "job_id")).alias("owner_id"))
    state = snapshots.current(spark, path)
    for _ in range(TRIES if touched else 0):
        base = state
        known = _claims(spark, path, base.writes, touched)
        write = _write(firsts.join(known, "digest", "left_anti"), path)
        if not spark.read.schema(CLAIMS).parquet(f"{path}/{write}").head(1):
            break  # every text has its owner already

        def claimed(s: Snapshot, seen: list[str] = base.writes, mine: str = write) -> Snapshot | None:
            return Snapshot(writes=[*s.writes, mine], applied=s.applied) if s.writes == seen else None

        state = snapshots.commit(spark, path, claimed)
        if write in state.writes:
            break
    else:
        if touched:
            raise RuntimeError(f"{path}: {TRIES} other writers were faster")
    owners = _claims(spark, path, state.writes, touched)
    repeats = keys.join(owners, "digest").where("owner_id <> job_id").groupBy("job_id").agg(F.min("owner_id").alias("owner_id"))
    return df.join(repeats, "job_id", "left").select(*df.columns, "owner_id")


def fold_owners(spark: SparkSession, path: str, least: int = 2) -> bool:
    """Put the claims of at least ``least`` writes into one; false if nothing changed. Claims are disjoint, so none is compared.

    Claims that land meanwhile stay beside the folded ones; a claimer that read the older list looks again.
    """
    before = snapshots.current(spark, path)
    if len(before.writes) < least:
        return False
    write = _write(_claims(spark, path, before.writes, None), path)

    def folded(s: Snapshot) -> Snapshot | None:
        if not set(before.writes) <= set(s.writes):
            return None
        return Snapshot(writes=[write, *(w for w in s.writes if w not in before.writes)], applied=s.applied)

    return write in snapshots.commit(spark, path, folded).writes
