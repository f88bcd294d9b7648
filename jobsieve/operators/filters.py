"""Filters over postings. An unknown is never a rejection, except where a filter asks for a known value."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.operators.search import search_score, terms_of


def split_list(v: str | None) -> list[str]:
    return [s for s in (p.strip().lower() for p in (v or "").split(",")) if s]


def spec_number(v, default=None, floor=None):
    """'' means not set, an explicit 0 means 0, anything unreadable falls back to the default."""
    if v is None or (isinstance(v, str) and not v.strip()):
        return default
    try:
        n = float(v)
    except (TypeError, ValueError):
        return default
    if math.isnan(n):
        return default
    n = int(n) if n == int(n) else n
    return n if floor is None else max(floor, n)


@dataclass(frozen=True)
class FilterSpec:
    """One filter set. Numbers may be given as text, the way a form hands them over."""

    q: str = ""
    workplace: tuple[str, ...] = ()
    apply: tuple[str, ...] = ()
    no_repost: bool = False
    no_promoted: bool = False
    no_seen: bool = False
    no_rejected: bool = False
    no_clearance: bool = False
    no_sponsor: bool = False
    no_reloc: bool = False
    no_fake_remote: bool = False
    has_pay: bool = False
    min_pay: str | float = ""
    max_yoe: str | float = ""
    max_travel: str | float = ""
    max_days: str | float = ""
    max_applicants: str | float = ""
    title_any: str = ""
    title_not: str = ""
    jd_all: str = ""
    jd_any: str = ""
    jd_not: str = ""
    company_not: str = ""
    min_chars: str | float = ""
    sort: str = "collected"

    def only(self, key: str) -> FilterSpec:
        """The same set with every other filter blanked."""
        return replace(FilterSpec(sort=self.sort), **{key: getattr(self, key)})


# Filter keys in display order with their labels.
LABELS = {
    "workplace": "workplace type", "apply": "application route", "no_repost": "hide reposted",
    "no_promoted": "hide promoted", "no_seen": "hide already exported",
    "no_rejected": "hide previously turned down", "no_clearance": "hide clearance required",
    "no_sponsor": "hide no-sponsorship", "no_reloc": "hide relocation required",
    "no_fake_remote": "hide fake remote", "has_pay": "pay found only", "min_pay": "min pay",
    "max_yoe": "max years required", "max_travel": "max travel", "max_days": "posted within",
    "max_applicants": "max applicants", "title_any": "title contains", "title_not": "title excludes",
    "jd_all": "JD contains all of", "jd_any": "JD contains any of", "jd_not": "JD excludes",
    "company_not": "excluded companies", "min_chars": "min JD length",
}

# The sentences that explain an empty list.
NOTE_SEARCH = ('Nothing matches "', '". It searches company, title, location and job id — clear it to see all ', " again.")
NOTE_UNSET = " collected jobs are hidden, but no filter is set."
NOTE_FILTERS = (" collected jobs are filtered out — ", ". Open the gear to change them, or Reset filters to clear them all.")


def active_filters(spec: FilterSpec) -> list[str]:
    """Keys that are set, in display order."""

    def is_set(key):
        v = getattr(spec, key)
        if isinstance(v, tuple | list):
            return len(v) > 0
        if isinstance(v, bool):
            return v
        if key == "min_chars":
            return (spec_number(v) or 0) > 0
        return str("" if v is None else v).strip() != ""

    return [k for k in LABELS if is_set(k)]


def _not_flagged(name: str) -> Column:
    return ~F.coalesce(F.col(name), F.lit(False))


def _known_in(name: str, unknown: str, wanted) -> Column:
    v = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(unknown))
    return (v == unknown) | v.isin(*wanted)


def _at_most(value: Column, limit) -> Column:
    return value.isNull() | (value <= F.lit(limit))


def _has(name: str, term: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(term))


def _any(name: str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_has(name, t) for t in terms])


def _all(name: str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [_has(name, t) for t in terms])


def predicates(spec: FilterSpec) -> dict[str, Column]:
    """Keep-conditions per active filter, cheapest first: flags and numbers, then text."""
    out: dict[str, Column] = {}
    flags = {
        "no_repost": "reposted", "no_promoted": "promoted", "no_clearance": "needs_clearance",
        "no_sponsor": "sponsorship_unavailable", "no_reloc": "requires_relocation",
        "no_fake_remote": "remote_contradiction", "no_seen": "seen", "no_rejected": "rejected",
    }
    if spec.workplace:
        out["workplace"] = _known_in("workplace_type", "Unknown", spec.workplace)
    if spec.apply:
        out["apply"] = _known_in("apply_type", "unknown", spec.apply)
    for key, name in flags.items():
        if getattr(spec, key):
            out[key] = _not_flagged(name)
    if spec.has_pay:
        out["has_pay"] = F.col("pay_min_annual").isNotNull()
    if (n := spec_number(spec.max_days)) is not None:
        out["max_days"] = _at_most(F.col("posted_days_ago"), n)
    if (n := spec_number(spec.max_applicants)) is not None:
        out["max_applicants"] = _at_most(F.col("applicants"), n)
    if n := spec_number(spec.min_chars):
        out["min_chars"] = F.coalesce(F.col("description_chars"), F.lit(0)) >= F.lit(n)
    if (n := spec_number(spec.min_pay)) is not None:
        # The top of the range has to clear the floor.
        top = F.coalesce(F.col("pay_max_annual"), F.col("pay_min_annual"))
        out["min_pay"] = top.isNull() | (top >= F.lit(n))
    if (n := spec_number(spec.max_yoe)) is not None:
        out["max_yoe"] = _at_most(F.col("yoe_min"), n)
    if (n := spec_number(spec.max_travel)) is not None:
        out["max_travel"] = _at_most(F.col("travel_pct"), n)
    if ts := split_list(spec.title_any):
        out["title_any"] = _any("title", ts)
    if ts := split_list(spec.title_not):
        out["title_not"] = ~_any("title", ts)
    if ts := split_list(spec.company_not):
        out["company_not"] = ~_any("company", ts)
    if ts := split_list(spec.jd_all):
        out["jd_all"] = _all("description", ts)
    if ts := split_list(spec.jd_any):
        out["jd_any"] = _any("description", ts)
    if ts := split_list(spec.jd_not):
        out["jd_not"] = ~_any("description", ts)
    return out


def mark_memory(
    df: DataFrame, spec: FilterSpec, history: DataFrame | None = None, verdicts: DataFrame | None = None
) -> DataFrame:
    """Add ``seen`` / ``rejected`` columns, each only when its filter is on (no join otherwise).

    Both memory sides are unique per id, so these are plain left joins: Spark broadcasts a small side by
    its size and otherwise sort-merges, splitting a skewed id at run time.
    """
    if spec.no_seen:
        seen = history.select("job_id").distinct().withColumn("seen", F.lit(True))
        df = df.join(seen, "job_id", "left")
    if spec.no_rejected:
        bad = verdicts.where("verdict = 'reject'").select("job_id").distinct().withColumn("rejected", F.lit(True))
        df = df.join(bad, "job_id", "left")
    return df


def apply_filters(
    df: DataFrame, spec: FilterSpec, history: DataFrame | None = None, verdicts: DataFrame | None = None
) -> DataFrame:
    """Rows that pass every active filter; the columns are those of the input."""
    keep = predicates(spec)
    base = df
    for k, cond in keep.items():
        if k not in ("no_seen", "no_rejected"):
            base = base.where(cond)
    if terms := terms_of(spec.q):
        base = base.where(search_score(terms, df.columns) >= 0)
    # Memory last, and as anti joins: only survivors are looked up.
    if spec.no_seen:
        base = base.join(history.select("job_id"), "job_id", "left_anti")
    if spec.no_rejected:
        base = base.join(verdicts.where("verdict = 'reject'").select("job_id"), "job_id", "left_anti")
    return base.select(*df.columns)


def filter_attribution(
    df: DataFrame, spec: FilterSpec, history: DataFrame | None = None, verdicts: DataFrame | None = None
) -> DataFrame:
    """How many rows each active filter removes on its own, worst first. One pass over the data."""
    keep = predicates(spec)
    keys = [k for k in LABELS if k in keep]
    if not keys:
        return df.sparkSession.createDataFrame([], "key string, label string, removed bigint, total bigint")
    marked = mark_memory(df, spec, history, verdicts)
    counts = marked.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~keep[k]).alias(k) for k in keys])
    entries = F.array(
        *[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.lit(LABELS[k]).alias("label"),
                   F.col(k).alias("removed")) for i, k in enumerate(keys)]
    )
    return (
        counts.select("total", F.inline(entries))
        .where("removed > 0")
        .orderBy(F.col("removed").desc(), "ord")
        .select("key", "label", "removed", "total")
    )


def explain_empty(
    df: DataFrame, spec: FilterSpec, history: DataFrame | None = None, verdicts: DataFrame | None = None
) -> DataFrame:
    """One row saying why the list is empty; no row when it is not empty."""
    # Three one-row answers, brought together as scalar subqueries.
    total = df.agg(F.count(F.lit(1)).alias("total"))
    left = apply_filters(df, spec, history, verdicts).limit(1).agg(F.count(F.lit(1))).scalar()
    base = total.where((F.col("total") > 0) & (left == 0))
    count = F.col("total").cast("string")
    if terms_of(spec.q):
        return base.select(F.concat(
            F.lit(NOTE_SEARCH[0] + spec.q.strip() + NOTE_SEARCH[1]), count, F.lit(NOTE_SEARCH[2])).alias("note"))
    rows = filter_attribution(df, spec, history, verdicts)
    # At most 23 rows: one per filter key.
    by = rows.agg(F.sort_array(F.collect_list(F.struct("removed", "label")), asc=False)).scalar()
    staged = base.withColumn("_by", by)
    head = F.array_join(
        F.transform(F.slice("_by", 1, 3), lambda r: F.concat(r["label"], F.lit(" ("), r["removed"], F.lit(")"))), ", ")
    more = F.when(F.size("_by") > 3, F.concat(F.lit(" and "), (F.size("_by") - 3).cast("string"), F.lit(" more")))
    unset = F.concat(F.lit("All "), count, F.lit(NOTE_UNSET))
    named = F.concat(
        F.lit("All "), count, F.lit(NOTE_FILTERS[0]), head, F.coalesce(more, F.lit("")), F.lit(NOTE_FILTERS[1]))
    return staged.select(F.when(F.size("_by") == 0, unset).otherwise(named).alias("note"))


def select_rows(df: DataFrame, deselected: DataFrame) -> DataFrame:
    """Everything the user did not untick."""
    return df.join(deselected.select("job_id"), "job_id", "left_anti")


def apply_targets(df: DataFrame) -> DataFrame:
    """External applications whose employer link is still unknown."""
    return df.where((F.col("apply_type") == "external") & (F.coalesce("apply_url", F.lit("")) == ""))


def filter_keys() -> list[str]:
    return [f.name for f in fields(FilterSpec)]
