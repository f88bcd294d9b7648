"""File sinks: CSV, JSON and batch texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.text import csv_cell

# CSV columns in order, with the header names other tools expect.
CSV_COLUMNS = {
    "job_id": "jobId", "title": "title", "company": "company", "location": "location",
    "workplace_type": "workplaceType", "apply_type": "applyType", "reposted": "reposted", "promoted": "promoted",
    "posted_raw": "postedRaw", "posted_days_ago": "postedDaysAgo", "applicants": "applicants",
    "employment_type": "employmentType", "seniority": "seniority", "pay_raw": "payRaw",
    "pay_min_annual": "payMinAnnual", "pay_max_annual": "payMaxAnnual", "pay_period": "payPeriod",
    "pay_source": "paySource", "yoe_min": "yoeMin", "travel_pct": "travelPct",
    "onsite_days_per_week": "onsiteDaysPerWeek", "needs_clearance": "needsClearance",
    "sponsorship_unavailable": "sponsorshipUnavailable", "requires_relocation": "requiresRelocation",
    "remote_contradiction": "remoteContradiction", "apply_url": "applyUrl", "source": "source",
    "ats_source": "atsSource", "description_chars": "descriptionChars", "url": "url", "description": "description",
}
BOM = "﻿"


def csv_lines(df: DataFrame) -> DataFrame:
    """``seq, value``: one CSV record per posting. Built as text because the CSV writer would rewrite line
    breaks inside cells."""
    have = set(df.columns)
    cells = [csv_cell(F.col(c) if c in have else F.lit(None).cast("string")) for c in CSV_COLUMNS]
    return df.select("seq", F.concat_ws(",", *cells).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Sorted part files that concatenate to one CSV: BOM and header first, CRLF between records."""
    header = df.sparkSession.createDataFrame([(None, BOM + ",".join(CSV_COLUMNS.values()), 0)], "seq bigint, value string, part int")
    lines = header.unionByName(csv_lines(df).withColumn("part", F.lit(1)))
    lines.orderBy("part", F.col("seq").asc_nulls_last(), "value").select("value").write.mode("overwrite").text(path, lineSep="\r\n")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_batches(batches: DataFrame, path: str) -> None:
    """Batch texts in order, a blank line between two."""
    batches.orderBy("batch_no").select("text").write.mode("overwrite").text(path, lineSep="\n\n")
