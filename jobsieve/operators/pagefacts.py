"""From located page parts to posting records, and checks on what came out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.functions import header as H
from jobsieve.functions.facts import extract_facts
from jobsieve.functions.text import norm_title, or_empty
from jobsieve.schema import as_postings

PART_COLUMNS = {
    "job_id": "string", "title": "string", "company": "string", "company_url": "string", "meta_line": "string",
    "top_text": "string", "pills": "array<string>", "description": "string", "apply_notice": "string",
    "apply_text": "string", "apply_aria": "string", "apply_href": "string", "card_text": "string",
    "collected_at": "timestamp", "seq": "bigint",
}


def build_postings(parts: DataFrame) -> DataFrame:
    """Parts (any subset of ``PART_COLUMNS``) to postings. Narrow: one scan, no shuffle."""
    full = parts.select(*[
        (F.col(c) if c in parts.columns else F.lit(None)).cast(kind).alias(c) for c, kind in PART_COLUMNS.items()
    ])
    pay_names = ["pay_raw", "pay_min", "pay_max", "pay_period", "pay_currency", "pay_min_annual", "pay_max_annual"]
    facts = extract_facts(full)
    staged = (
        facts.withColumn("_meta", H.split_meta_line("meta_line", "company"))
        .withColumn("_pill", H.classify_pills("pills"))
        .withColumn("_location", or_empty("_meta.location"))
        .withColumn("_work", H.workplace_fallback(
            F.coalesce("_meta.workplace", "_pill.workplace"), "top_text", F.col("_location")))
        .withColumn("_posted", H.posted_fallback(F.col("_meta.posted_raw"), "top_text"))
        .withColumn("_pay", H.pay_precedence("_pill.salary", F.struct(*pay_names)))
        .withColumn("_card", H.card_flags("card_text"))
        .withColumn("_apply", H.apply_type("apply_notice", "apply_text", "apply_aria"))
    )
    href = F.when(F.col("_apply") == "external", H.external_href("apply_href")).otherwise("")
    out = staged.select(
        "job_id",
        F.concat(F.lit(H.BOARD_JOB_URL), "job_id", F.lit("/")).alias("url"),
        or_empty("title").alias("title"), or_empty("company").alias("company"),
        or_empty("company_url").alias("company_url"), F.col("_location").alias("location"),
        F.col("_work").alias("workplace_type"), F.col("_posted").alias("posted_raw"),
        H.ago_to_days("_posted").alias("posted_days_ago"),
        H.is_reposted("meta_line", "top_text").alias("reposted"),
        F.coalesce("_meta.applicants", H.parse_applicants("top_text")).alias("applicants"),
        F.col("_card.promoted").alias("promoted"), F.col("_card.viewed").alias("viewed"),
        F.col("_apply").alias("apply_type"),
        F.when(F.col("_apply") == "closed", F.col("apply_notice")).otherwise(or_empty("apply_text")).alias("apply_label"),
        href.alias("apply_url"), F.when(href != "", "from-link").otherwise("").alias("apply_url_status"),
        or_empty("_pill.employment_type").alias("employment_type"), or_empty("_pill.seniority").alias("seniority"),
        or_empty("_pill.salary").alias("salary"), "_pay.*", "yoe_min", "yoe_mentions", "needs_clearance",
        "sponsorship_unavailable", "requires_relocation", "not_remote", "travel_pct", "onsite_days_per_week",
        H.remote_contradiction("_work", "not_remote", "onsite_days_per_week").alias("remote_contradiction"),
        "flag_snippets", or_empty("description").alias("description"),
        F.length(or_empty("description")).alias("description_chars"),
        F.left(or_empty("top_text"), F.lit(400)).alias("top_card_text"), "collected_at", "seq",
    )
    return as_postings(out)


def thin_jobs(postings: DataFrame) -> DataFrame:
    """Rows that look collected but are not usable, with the first reason."""
    return postings.withColumn("thin_reason", H.thin_reason("description", "title", "company")).where(
        "thin_reason is not null")


def field_audit(parts: DataFrame, min_chars: int = 100) -> DataFrame:
    """Per job: which gate fields are missing and how long each field is - lengths, never contents."""
    n = lambda c: F.length(or_empty(c))
    link = H.job_id_from_href("link_href") if "link_href" in parts.columns else F.col("job_id")
    missing = F.array_compact(F.array(
        F.when(link.isNull(), F.lit("titleLink")),
        F.when(link.isNotNull() & (link != F.col("job_id")), F.concat(
            F.lit("titleLink.href names "), link, F.lit(", not "), "job_id")),
        F.when(or_empty("title") == "", F.lit("title")),
        F.when(n("description") <= min_chars, F.concat(
            F.lit(f"description>{min_chars} (got "), n("description").cast("string"), F.lit(")"))),
    ))
    return parts.select(
        "job_id", missing.alias("missing"), (F.size(missing) == 0).alias("ok"),
        n("title").alias("title_length"), n("company").alias("company_length"),
        n("meta_line").alias("location_length"), n("description").alias("description_length"),
        F.greatest(F.size("pills"), F.lit(0)).alias("pill_count"),
    )


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """How many rows have each field filled. One pass."""
    filled = {c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "") for c in fields}
    one = df.agg(F.count(F.lit(1)).alias("_total"), *[v.alias(k) for k, v in filled.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in fields])
    return one.select(F.inline(rows), F.col("_total").alias("total"))


def detail_matches_listing(details: DataFrame, listings: DataFrame, min_chars: int = 120) -> DataFrame:
    """Details that really belong to their listing row: ids agree, titles contain one another, text is real.

    Where details carry ``signature`` and ``before`` (of the pane now and before the click), a pane that changed is proof
    enough without agreeing titles.
    """
    a = details.select("job_id", F.col("title").alias("_t1"), *[c for c in details.columns if c not in ("job_id", "title")])
    b = listings.select("job_id", F.col("title").alias("_t2"))
    j = a.join(b, "job_id").withColumn("_n1", norm_title("_t1")).withColumn("_n2", norm_title("_t2"))
    agree = (F.col("_n1") != "") & (F.col("_n2") != "") & (F.contains("_n1", "_n2") | F.contains("_n2", "_n1"))
    if {"signature", "before"} <= set(details.columns):
        agree = agree | F.coalesce((F.col("signature") != "") & (F.col("signature") != F.col("before")), F.lit(False))
    id_ok = F.lit(True)
    if "url_id" in details.columns:
        id_ok = F.coalesce("url_id", F.lit("")).isin("") | (F.col("url_id") == F.col("job_id"))
    return j.where(agree & id_ok & (F.length("description") > min_chars)).select(
        "job_id", F.col("_t1").alias("title"), *[c for c in details.columns if c not in ("job_id", "title")])
