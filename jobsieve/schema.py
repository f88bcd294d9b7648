"""The posting record and the small memory tables, as column types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSTING = {
    "job_id": "string", "url": "string", "title": "string", "company": "string", "company_url": "string",
    "location": "string", "workplace_type": "string", "workplace_raw": "string", "posted_raw": "string",
    "posted_days_ago": "int", "reposted": "boolean", "applicants": "int", "promoted": "boolean",
    "viewed": "boolean", "apply_type": "string", "apply_label": "string", "apply_url": "string",
    "apply_url_status": "string", "employment_type": "string", "seniority": "string", "salary": "string",
    "pay_raw": "string", "pay_min": "double", "pay_max": "double", "pay_period": "string",
    "pay_currency": "string", "pay_min_annual": "bigint", "pay_max_annual": "bigint", "pay_source": "string",
    "yoe_min": "int", "yoe_mentions": "array<struct<years:int,snippet:string>>", "needs_clearance": "boolean",
    "sponsorship_unavailable": "boolean", "requires_relocation": "boolean", "not_remote": "boolean",
    "travel_pct": "int", "onsite_days_per_week": "int", "remote_contradiction": "boolean",
    "flag_snippets": "map<string,string>", "description": "string", "description_chars": "int",
    "description_source": "string", "top_card_text": "string", "collected_at": "timestamp", "source": "string",
    "ats_source": "string", "board_token": "string", "dedup_key": "string", "is_expired": "boolean",
    "certifications": "array<string>", "tools": "array<string>", "company_website": "string",
    "ai_fields": "map<string,string>", "seq": "bigint",
}
HISTORY = {"job_id": "string", "exported_at": "timestamp"}
VERDICTS = {"job_id": "string", "verdict": "string", "reason": "string", "at": "timestamp", "source": "string"}
PLANS = {"path": "string", "plan": "map<string,string>", "notes": "string", "model": "string", "at": "timestamp"}
LOG = {"t": "timestamp", "line": "string"}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def as_postings(df: DataFrame) -> DataFrame:
    """Bring any posting-like table to the full record: absent columns become null, types are fixed."""
    have = set(df.columns)
    return df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in POSTING.items()]
    )


def union_postings(*parts: DataFrame) -> DataFrame:
    """Rows of several collectors in one shape; a key only one side has is null on the other."""
    out = as_postings(parts[0])
    for p in parts[1:]:
        out = out.unionByName(as_postings(p))
    return out
