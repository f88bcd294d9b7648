"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated. A document's virtual finish time is its source's
cumulative words divided by the source's target. Since the targets add up to the total budget and no target exceeds
what its queue holds, every queue has sent exactly its target at virtual time 1, and so the budget is spent exactly
there: the cut needs no global running total. The document in service at the cut gives the words sent until then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.llm.store import count_words, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
# Digits of the shuffle key: 256 coarse bins per source and 4,096 fine ones in each, so that no running total is over
# more than 4,096 sums, and a source of 10^10 documents has 10^4 in a fine bin.
COARSE, FINE = 2, 5


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(queue, source_size, target)``: the water level at which capped shares add up to the budget.

    One slim row per source is all these windows see. A source is full if its cap is below its share of what the fuller
    ones leave; the rest divide the remainder by weight.
    """
    per = sizes.groupBy("queue", "source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.array(*map(F.lit, weights))[place % len(weights)])
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("full", F.col("cap") * heavy <= left * F.col("weight"))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    return per.select("queue", "source_size", F.when(F.col("full"), F.col("cap").cast("double"))
                      .otherwise(rest / open_weight * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS,
             row: Column | None = None) -> DataFrame:
    """Per row: ``doc_id, source, size, source_size, target, taken, before, epochs, key, row``; ``row`` is carried along.

    ``epochs`` lists ``(epoch, words, finish)`` for every time the document is sent, ``taken`` adds their words up.
    The shuffle is by hash of ``doc_id``, so reruns agree; rows that repeat a ``doc_id`` tie and stand next to each
    other. Null source is a source, the last one; null or empty text has size 0 and is never sent; extra columns are
    ignored; an empty table gives none.
    """
    slim = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(text_col).alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("queue"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        (row if row is not None else F.lit(None).cast("string")).alias("row")), "mix-sizes")
    slim = slim.withColumn("c", F.substring("key", 1, COARSE)).withColumn("f", F.substring("key", 1, FINE))
    fine = slim.groupBy("queue", "c", "f").agg(F.sum("size").alias("words"))
    coarse = slim.groupBy("queue", "c").agg(F.sum("size").alias("words"))
    so_far = lambda *by, order: F.coalesce(
        F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select("queue", "c", so_far("queue", order="c").alias("c_before"))
    bins = (fine.select("queue", "c", "f", so_far("queue", "c", order="f").alias("f_before"))
            .join(coarse, ["queue", "c"])
            .join(source_targets(slim, weights, share, max_repeats), "queue")
            .select("queue", "f", (F.col("c_before") + F.col("f_before")).alias("bin_before"), "source_size", "target"))
    here = Window.partitionBy("queue", "f").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = (slim.join(bins, ["queue", "f"])
            .withColumn("before", F.col("bin_before") + F.coalesce(F.sum("size").over(here), F.lit(0))))
    cut = F.floor("target")

    def sent(epoch: int):
        start = F.col("before") + F.col("source_size") * epoch
        words = F.least(F.col("size"), F.greatest(cut - start, F.lit(0).cast("long")))
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"),
                        ((start + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0))).alias("finish"))

    epochs = F.filter(F.array(*map(sent, range(max_repeats))), lambda e: e["words"] > 0)
    rows = rows.withColumn("epochs", epochs)
    taken = F.aggregate("epochs", F.lit(0).cast("long"), lambda total, e: total + e["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "before", "epochs", "key", "row")


def mix_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: ``(doc_id, source, epoch, words, size, finish)`` globally sorted by virtual finish time."""
    plan = mix_plan(docs, id_col, text_col, source_col, weights, share, max_repeats)
    sends = plan.select("doc_id", "source", "size", "key", F.explode("epochs").alias("e"))
    return (sends.select("doc_id", "source", "e.epoch", "e.words", "size", "e.finish", "key")
            .orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id").drop("key"))
