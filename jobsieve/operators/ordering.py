"""Sorting, top rows, caps and global row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.operators.search import search_score, terms_of
from jobsieve.session import durable

# What a missing sort key counts as, and how many rows a list shows.
NO_AGE = 9999
NO_PAY = -1
NO_APPLICANTS = 1_000_000_000
DISPLAY_ROWS = 300
LOG_ROWS = 300

_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def sort_values(mode: str = "collected", q: str = "", columns: Sequence[str] = ()) -> list[tuple[Column, bool]]:
    """What a mode sorts by, and whether upwards; ``seq`` last makes the order total, which is what a stable sort gives."""
    values: list[tuple[Column, bool]] = []
    if terms := terms_of(q):
        values.append((search_score(terms, columns), False))
    if mode == "posted":
        values.append((F.coalesce("posted_days_ago", F.lit(NO_AGE)), True))
    elif mode == "pay":
        values.append((F.coalesce("pay_max_annual", "pay_min_annual", F.lit(NO_PAY)), False))
    elif mode == "applicants":
        values.append((F.coalesce("applicants", F.lit(NO_APPLICANTS)), True))
    return [*values, (F.col("seq"), True)]


def sort_keys(mode: str = "collected", q: str = "", columns: Sequence[str] = ()) -> list[Column]:
    """The sort columns of a mode."""
    return [v.asc() if up else v.desc() for v, up in sort_values(mode, q, columns)]


def sort_jobs(df: DataFrame, mode: str = "collected", q: str = "") -> DataFrame:
    return df.orderBy(*sort_keys(mode, q, df.columns))


def top_rows(df: DataFrame, mode: str = "collected", q: str = "", n: int = DISPLAY_ROWS) -> DataFrame:
    """The display list. Sort plus limit becomes one TakeOrderedAndProject: no full sort, no shuffle of rows."""
    return sort_jobs(df, mode, q).limit(n)


def cap_jobs(df: DataFrame, max_jobs: int, order: Sequence[Column | str] = ("seq",)) -> DataFrame:
    """First ``max_jobs`` in order; 0 means no limit. Put it before the description join."""
    return df.orderBy(*order).limit(max_jobs) if max_jobs > 0 else df


def cap_pages(df: DataFrame, max_pages: int, page: str = "page_no") -> DataFrame:
    """Pages are numbered from 1, so the cap is a filter that reaches the scan."""
    return df.where(F.col(page) <= max_pages) if max_pages > 0 else df


def recent_log(log: DataFrame, n: int = LOG_ROWS) -> DataFrame:
    """The newest lines; lines of one time stand in the order of their other columns."""
    return log.orderBy(F.col("t").desc(), *[c for c in log.columns if c != "t"]).limit(n)


def verdict_list(verdicts: DataFrame) -> DataFrame:
    return verdicts.orderBy(F.col("at").desc(), "job_id")


def number_rows(df: DataFrame, order: Sequence[Column | str], into: str = "row_no") -> DataFrame:
    """1-based row numbers over the whole table, without ever putting the table in one partition.

    Rows are range-partitioned and sorted, written once (so the layout cannot change under a lost
    executor), and each partition's rows are shifted by the count of the partitions before it. Only the
    per-partition counts - one row per partition - are broadcast.
    """
    sorted_parts = durable(df.repartitionByRange(*order).sortWithinPartitions(*order))
    local = sorted_parts.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_mid", _PARTITION_BITS)
    counts = local.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.selectExpr("_part", "sum(_n) over (order by _part) - _n as _start")
    within = F.col("_mid").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return (
        local.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(into, F.col("_start") + within + 1)
        .drop("_mid", "_part", "_start")
    )


def number_jobs(df: DataFrame, order: Sequence[Column | str] = ("seq",)) -> DataFrame:
    """The running number each posting carries through an export."""
    return number_rows(df, order, "job_no")
