"""Incremental intake: postings, counters and verdicts as they arrive.

Arrival order is the only time the semantics know, so there are no watermarks. Each micro-batch is
idempotent against its store, which together with the checkpoint makes a restart harmless.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from jobsieve.operators.verdicts import latest_verdict, parse_verdicts, read_chat_lines
from jobsieve.schema import POSTING, VERDICTS, as_postings
from jobsieve.sources.memory import COMPACT_AFTER, fold_memory, stored_ids, upsert_memory, write_postings

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLUSH = "1200 milliseconds"  # fixed value: how long writes are gathered


def read_arrivals(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files under ``path`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=FLUSH)).start()


class FirstArrival(StatefulProcessor):
    """Lets the first row of an id through, once in the life of the stream; what is kept of an id is one mark."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            return
        self.seen.update((True,))
        # Rows without an order come last.
        yield min(rows, key=lambda r: (r["seq"] is None, r["seq"] or 0))


def stream_intake(arrivals: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append postings whose id is new: first arrival wins inside a batch, earlier batches and the store win across batches.

    Which ids were seen is state of the stream, kept in RocksDB and checkpointed by id: no batch reads the store. What the
    store holds when the stream first starts is read once, as the first state. A replayed batch finds the state as it was before it, and
    writes the same rows over its own.
    """
    spark = arrivals.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    # Only what arrives goes through the state; the columns a posting has besides are added where it is stored.
    come = arrivals.select(*[F.col(c).cast(kind).alias(c) for c, kind in POSTING.items() if c in arrivals.columns])
    first = come.groupBy("job_id").transformWithState(
        FirstArrival(), come.schema, "Append", "None", initialState=stored_ids(spark, store).distinct().groupBy("job_id"))

    def land(batch: DataFrame, batch_id: int) -> None:
        write_postings(as_postings(batch), store, f"{run}-{batch_id}")

    return _start(first.writeStream.foreachBatch(land), checkpoint, once)


def stream_counters(outcomes: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Running counts per run and outcome; each batch appends its own counts, readers sum them."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def land(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
        # One folder per checkpoint and batch, overwritten on replay: a retried batch does not count twice, and a new
        # checkpoint, which numbers its batches from 0 again, overwrites nothing.
        counts.write.mode("overwrite").parquet(f"{table}/checkpoint={run}/batch={batch_id}")

    return _start(outcomes.writeStream.foreachBatch(land), checkpoint, once)


def read_counters(spark: SparkSession, table: str) -> DataFrame:
    rows = spark.read.schema("run_id string, outcome string, n bigint").parquet(table)
    return rows.groupBy("run_id", "outcome").agg(F.sum("n").alias("n"))


def stream_verdicts(chats: DataFrame, memory: str, checkpoint: str, source: str = "chat", once: bool = False) -> StreamingQuery:
    """Verdict lines to memory; a later verdict for an id replaces an earlier one when read. Every so many writes are folded into one."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def land(batch: DataFrame, batch_id: int) -> None:
        found = latest_verdict(parse_verdicts(read_chat_lines(batch, "text", "conv_id", "turn")))
        stamped = found.select(
            "job_id", "verdict", "reason", F.current_timestamp().alias("at"), F.lit(source).alias("source"))
        upsert_memory(stamped, memory, run, batch_id)
        fold_memory(batch.sparkSession, memory, VERDICTS, "job_id", "at", COMPACT_AFTER)

    return _start(chats.writeStream.foreachBatch(land), checkpoint, once)
