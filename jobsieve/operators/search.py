"""Ranked search: every term must land somewhere, and where it lands decides the order."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Searched columns and their weights; the id counts only when it is the whole term.
ID_WEIGHT = 100
WEIGHTS = {"company": 40, "title": 30, "location": 12, "company_url": 6, "description": 3}


def terms_of(q: str | None) -> list[str]:
    return re.split(r"\s+", q.lower().strip()) if q and q.strip() else []


def _term_score(term: str, columns: Sequence[str]) -> Column:
    t = F.lit(term)
    best = []
    if "job_id" in columns:
        best.append(F.when(F.lower(F.coalesce("job_id", F.lit(""))) == t, ID_WEIGHT).otherwise(0))
    for name, w in WEIGHTS.items():
        if name not in columns:
            continue
        v = F.lower(F.coalesce(name, F.lit("")))
        best.append(
            F.when(v == t, 3 * w).when(F.startswith(v, t), 2 * w).when(F.contains(v, t), w).otherwise(0)
        )
    return F.greatest(*best, F.lit(0))


def search_score(terms: Sequence[str], columns: Sequence[str]) -> Column:
    """-1 when any term is nowhere, else the sum of each term's best field."""
    if not terms:
        return F.lit(0)
    scores = [_term_score(t, columns) for t in terms]
    hit_all = scores[0] > 0
    for s in scores[1:]:
        hit_all = hit_all & (s > 0)
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return F.when(hit_all, total).otherwise(-1)


def search(df: DataFrame, q: str, score: str = "score") -> DataFrame:
    """Rows where every term matches, with their score. An empty search keeps all rows at 0."""
    return df.withColumn(score, search_score(terms_of(q), df.columns).cast("int")).where(F.col(score) >= 0)
