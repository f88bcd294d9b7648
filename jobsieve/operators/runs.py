"""Run bookkeeping: counters, stage funnel, page checks and stop conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: outcomes and stages, in order ----
OUTCOMES = ["collected", "skipped", "failed"]
STAGES = ["CARD_DISCOVERED", "CARD_CLICKED", "SELECTION_SYNCED", "EXTRACTED", "VALIDATED", "PAYLOAD",
          "SAVE_RESPONSE", "STATUS"]
MIN_CARDS = 3
DISTINCT_SHARE = 0.6
BARREN_PAGES = 2
# ---- end of fixed values ----


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Per run: counts per outcome, pages done and the stop reason (the last one stated).

    ``outcomes(run_id, page_no, outcome, reason, seq)``
    """
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return outcomes.groupBy("run_id").agg(
        *counts, F.max("page_no").alias("pages_done"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("reason"))


def ids_per_page_check(cards: DataFrame, page: str = "page_id") -> DataFrame:
    """Per page: cards, distinct ids, and whether ids may be trusted to tell cards apart."""
    # Two steps keep a page with very many cards from meeting in one task before it is reduced.
    per_id = cards.groupBy(page, "job_id").agg(F.count(F.lit(1)).alias("n"))
    out = per_id.groupBy(page).agg(F.sum("n").alias("cards"), F.count("job_id").alias("distinct_ids"))
    need = F.greatest(F.lit(2), F.ceil(F.col("cards") * DISTINCT_SHARE))
    return out.withColumn(
        "by_position", (F.col("distinct_ids") == 0) | ((F.col("cards") >= MIN_CARDS) & (F.col("distinct_ids") < need)))


def stage_counts(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


def first_failures(stages: DataFrame) -> DataFrame:
    """Per job: the first failing stage and its reason. ``stages(job_id, stage, ord, status, reason)``"""
    failed = stages.where("status = 'failed'")
    return failed.groupBy("job_id").agg(F.min_by(F.struct("stage", "reason"), "ord").alias("_f")).select("job_id", "_f.*")


def stage_funnel(stages: DataFrame) -> DataFrame:
    """How many jobs reached each stage and how many stopped there."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    per_job = stages.groupBy("job_id", "stage").agg(F.max((F.col("status") == "failed").cast("int")).alias("bad"))
    return per_job.groupBy("stage").agg(
        F.count(F.lit(1)).alias("reached"), F.sum("bad").alias("stopped")).withColumn("stage_no", rank.cast("int"))


def barren_streak(pages: DataFrame, n: int = BARREN_PAGES) -> DataFrame:
    """Per run: the page on which the n-th consecutive page without a new id was seen (null if never).

    ``pages(run_id, page_no, new_ids)``, pages numbered one by one. A page pairs with its predecessors by
    equality, so a run with very many pages spreads over all tasks.
    """
    barren = pages.where("new_ids = 0").select("run_id", "page_no")
    streak = barren
    for back in range(1, n):
        streak = streak.join(barren.select("run_id", (F.col("page_no") + back).alias("page_no")), ["run_id", "page_no"])
    stops = streak.groupBy("run_id").agg(F.min("page_no").alias("stop_page"))
    return pages.select("run_id").distinct().join(stops, "run_id", "left")


def new_ids_per_page(cards: DataFrame) -> DataFrame:
    """``run_id, page_no, cards, new_ids``: an id is new on the first page of the run that shows it."""
    per_page = cards.groupBy("run_id", "page_no").agg(F.count(F.lit(1)).alias("cards"))
    firsts = cards.groupBy("run_id", "job_id").agg(F.min("page_no").alias("page_no"))
    new = firsts.groupBy("run_id", "page_no").agg(F.count(F.lit(1)).alias("new_ids"))
    return per_page.join(new, ["run_id", "page_no"], "left").na.fill(0, ["new_ids"])
