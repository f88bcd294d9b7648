"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

Every query reads whole tables. Queries without SQL are those SQL cannot express; they are tested
against brute force on small fixtures instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsieve.functions import facts as X
from jobsieve.functions import header as H
from jobsieve.functions.htmltext import html_to_text
from jobsieve.functions.text import csv_cell, norm_title, pane_signature, squash_lower
from jobsieve.operators import blocks as B
from jobsieve.operators import claims as C
from jobsieve.operators import dedupe as D
from jobsieve.operators import exporting as E
from jobsieve.operators import filters as FL
from jobsieve.operators import hits as N
from jobsieve.operators import ordering as O
from jobsieve.operators import outline as OL
from jobsieve.operators import pagefacts as P
from jobsieve.operators import runs as R
from jobsieve.operators import search as S
from jobsieve.operators import verbatim as VB
from jobsieve.operators import verdicts as V
from jobsieve.plans import pipelines as L
from jobsieve.plans.views import (
    CHARS_PAD, SQL_POSTINGS, base_postings, board_pages, chats, details, postings, prose, search_pages, spread, table,
)
from jobsieve.schema import HISTORY, VERDICTS, union_postings
from jobsieve.session import scratch
from jobsieve.sources import memory as M
from jobsieve.sources import owners as OW
from jobsieve.sources import sinks as SK
from jobsieve.streaming import intake as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def over_postings(select: str) -> str:
    return f"WITH {SQL_POSTINGS} {select}"


# ---- filters ----

ALL_FILTERS = {
    "workplace": (dict(workplace=("Remote", "Hybrid")),
                  "coalesce(workplace_type, 'Unknown') IN ('Unknown', 'Remote', 'Hybrid')"),
    "apply": (dict(apply=("external",)), "coalesce(apply_type, 'unknown') IN ('unknown', 'external')"),
    "no_repost": (dict(no_repost=True), "coalesce(reposted, false) = false"),
    "no_promoted": (dict(no_promoted=True), "NOT promoted"),
    "no_clearance": (dict(no_clearance=True), "coalesce(needs_clearance, false) = false"),
    "no_sponsor": (dict(no_sponsor=True), "coalesce(sponsorship_unavailable, false) = false"),
    "no_reloc": (dict(no_reloc=True), "coalesce(requires_relocation, false) = false"),
    "no_fake_remote": (dict(no_fake_remote=True), "NOT remote_contradiction"),
    "has_pay": (dict(has_pay=True), "pay_min_annual IS NOT NULL"),
    "min_pay": (dict(min_pay="250000"), "(coalesce(pay_max_annual, pay_min_annual) IS NULL OR "
                "coalesce(pay_max_annual, pay_min_annual) >= 250000)"),
    "max_yoe": (dict(max_yoe="5"), "(yoe_min IS NULL OR yoe_min <= 5)"),
    "max_travel": (dict(max_travel="25"), "(travel_pct IS NULL OR travel_pct <= 25)"),
    "max_days": (dict(max_days="900"), "(posted_days_ago IS NULL OR posted_days_ago <= 900)"),
    "max_applicants": (dict(max_applicants="100"), "(applicants IS NULL OR applicants <= 100)"),
    "title_any": (dict(title_any="Urgent, machinery"), "(contains(lower(title), 'urgent') OR contains(lower(title), 'machinery'))"),
    "title_not": (dict(title_not="building,low"), "NOT (contains(lower(title), 'building') OR contains(lower(title), 'low'))"),
    "company_not": (dict(company_not="000007,00001"), "NOT (contains(lower(company), '000007') OR contains(lower(company), '00001'))"),
    "jd_all": (dict(jd_all="sql, reference f"), "(contains(lower(coalesce(description, '')), 'sql') AND "
               "contains(lower(coalesce(description, '')), 'reference f'))"),
    "jd_any": (dict(jd_any="python,reference o"), "(contains(lower(coalesce(description, '')), 'python') OR "
               "contains(lower(coalesce(description, '')), 'reference o'))"),
    "jd_not": (dict(jd_not="python"), "NOT contains(lower(coalesce(description, '')), 'python')"),
    "min_chars": (dict(min_chars="196"), "length(coalesce(description, '')) >= 196"),
}


def _add_filter(key: str, spec: dict, where: str) -> None:
    def run(spark, d):
        return FL.apply_filters(base_postings(spark, d), FL.FilterSpec(**spec)).select("job_id", "title")

    QUERIES[f"filter_{key}"] = run
    ORACLES[f"filter_{key}"] = over_postings(f"SELECT job_id, title FROM postings WHERE {where}")


for _key, (_spec, _where) in ALL_FILTERS.items():
    _add_filter(_key, _spec, _where)

EVERY = FL.FilterSpec(**{k: v for s, _ in ALL_FILTERS.values() for k, v in s.items()}, no_seen=True, no_rejected=True)
LOOSE = FL.FilterSpec(workplace=("Remote", "Hybrid"), min_pay="120000", max_yoe=15, max_travel="80", no_repost=True,
                      no_clearance=True, max_days="2000", jd_not="python")


def history(spark, d):
    """Exported ids: the orders of every third customer."""
    return table(spark, d, "orders").where("o_custkey % 3 = 0").select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("exported_at"))


def verdict_rows(spark, d):
    """Verdicts for labelled documents, keyed like postings."""
    return table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("verdict"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("reason"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("at"), F.lit("chat").alias("source"))


SQL_HISTORY = "history AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_custkey % 3 = 0)"
SQL_VERDICTS = ("verdicts AS (SELECT CAST(doc_id AS VARCHAR) AS job_id, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' "
                "END AS verdict, 'toxic ' || toxic AS reason FROM labels)")


@query("filter_no_seen", f"WITH {SQL_POSTINGS}, {SQL_HISTORY} SELECT job_id FROM postings p WHERE NOT EXISTS "
       "(SELECT 1 FROM history h WHERE h.job_id = p.job_id)")
def _(spark, d):
    return FL.apply_filters(base_postings(spark, d), FL.FilterSpec(no_seen=True), history(spark, d)).select("job_id")


@query("filter_no_rejected", f"WITH {SQL_POSTINGS}, {SQL_VERDICTS} SELECT job_id FROM postings p WHERE NOT EXISTS "
       "(SELECT 1 FROM verdicts v WHERE v.job_id = p.job_id AND v.verdict = 'reject')")
def _(spark, d):
    return FL.apply_filters(base_postings(spark, d), FL.FilterSpec(no_rejected=True), None, verdict_rows(spark, d)).select("job_id")


@query("filter_combined", over_postings(
    "SELECT job_id, company, pay_min_annual FROM postings WHERE coalesce(workplace_type, 'Unknown') IN ('Unknown', 'Remote', 'Hybrid') "
    "AND (coalesce(pay_max_annual, pay_min_annual) IS NULL OR coalesce(pay_max_annual, pay_min_annual) >= 120000) "
    "AND (yoe_min IS NULL OR yoe_min <= 15) AND (travel_pct IS NULL OR travel_pct <= 80) AND coalesce(reposted, false) = false "
    "AND coalesce(needs_clearance, false) = false AND (posted_days_ago IS NULL OR posted_days_ago <= 2000) "
    "AND NOT contains(lower(coalesce(description, '')), 'python')"))
def _(spark, d):
    return FL.apply_filters(base_postings(spark, d), LOOSE).select("job_id", "company", "pay_min_annual")


def _attribution_sql() -> str:
    parts = [(k, f"count(*) FILTER (WHERE NOT ({w}))") for k, (_, w) in ALL_FILTERS.items()]
    parts += [("no_seen", "count(*) FILTER (WHERE job_id IN (SELECT job_id FROM history))"),
              ("no_rejected", "count(*) FILTER (WHERE job_id IN (SELECT job_id FROM verdicts WHERE verdict = 'reject'))")]
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS key, '{FL.LABELS[k]}' AS label, {c} AS removed, count(*) AS total FROM postings" for k, c in parts)
    return f"WITH {SQL_POSTINGS}, {SQL_HISTORY}, {SQL_VERDICTS} SELECT * FROM ({rows}) WHERE removed > 0"


@query("filter_attribution", _attribution_sql())
def _(spark, d):
    return FL.filter_attribution(base_postings(spark, d), EVERY, history(spark, d), verdict_rows(spark, d))


@query("explain_empty", over_postings(
    "SELECT 'All ' || count(*) || ' collected jobs are filtered out — title contains (' || count(*) || '), min pay (' || "
    "count(*) FILTER (WHERE coalesce(pay_max_annual, pay_min_annual) < 900000) || '). Open the gear to change them, or Reset "
    "filters to clear them all.' AS note FROM postings"))
def _(spark, d):
    return FL.explain_empty(base_postings(spark, d), FL.FilterSpec(title_any="nowhere", min_pay="900000"))


@query("select_rows", over_postings("SELECT job_id FROM postings WHERE job_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"))
def _(spark, d):
    off = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("job_id"))
    return FL.select_rows(base_postings(spark, d), off).select("job_id")


@query("apply_targets", over_postings("SELECT job_id FROM postings WHERE apply_type = 'external' AND coalesce(apply_url, '') = ''"))
def _(spark, d):
    return FL.apply_targets(base_postings(spark, d)).select("job_id")


# ---- search and order ----

def _score_sql(term: str) -> str:
    parts = [f"CASE WHEN lower(job_id) = '{term}' THEN 100 ELSE 0 END"]
    for c, w in S.WEIGHTS.items():
        v = f"lower(coalesce({c}, ''))"
        parts.append(f"CASE WHEN {v} = '{term}' THEN {3 * w} WHEN starts_with({v}, '{term}') THEN {2 * w} "
                     f"WHEN contains({v}, '{term}') THEN {w} ELSE 0 END")
    return f"greatest({', '.join(parts)})"


_SCORED = (f"scored AS (SELECT *, {_score_sql('machinery')} AS s1, {_score_sql('nation_7')} AS s2 FROM postings), "
           "hits AS (SELECT *, CAST(s1 + s2 AS INTEGER) AS score FROM scored WHERE s1 > 0 AND s2 > 0)")


@query("search_rank", f"WITH {SQL_POSTINGS}, {_SCORED} SELECT job_id, score FROM hits")
def _(spark, d):
    return S.search(base_postings(spark, d), "Machinery nation_7").select("job_id", "score")


def _ranked(df: DataFrame, keys) -> DataFrame:
    # At most 300 rows: the display list.
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))


@query("search_top", f"WITH {SQL_POSTINGS}, {_SCORED} SELECT job_id, score, rank FROM (SELECT job_id, score, row_number() OVER "
       "(ORDER BY score DESC, coalesce(pay_max_annual, pay_min_annual, -1) DESC, seq) AS rank FROM hits) WHERE rank <= 300")
def _(spark, d):
    q = "Machinery nation_7"
    found = S.search(base_postings(spark, d), q)
    keys = [F.col("score").desc(), *O.sort_keys("pay")]
    return _ranked(found.orderBy(*keys).limit(O.DISPLAY_ROWS), keys).select("job_id", "score", "rank")


_SORTS = {
    "pay": "coalesce(pay_max_annual, pay_min_annual, -1) DESC", "posted": "coalesce(posted_days_ago, 9999)",
    "applicants": "coalesce(applicants, 1000000000)", "collected": "1",
}


def _add_sort(mode: str, key: str) -> None:
    def run(spark, d):
        return _ranked(O.top_rows(base_postings(spark, d), mode), O.sort_keys(mode)).select("job_id", "rank")

    QUERIES[f"sort_{mode}"] = run
    ORACLES[f"sort_{mode}"] = over_postings(
        f"SELECT job_id, rank FROM (SELECT job_id, row_number() OVER (ORDER BY {key}, seq) AS rank FROM postings) WHERE rank <= 300")


for _mode, _order in _SORTS.items():
    _add_sort(_mode, _order)


@query("number_jobs", over_postings("SELECT job_id, row_number() OVER (ORDER BY coalesce(pay_max_annual, pay_min_annual, -1) DESC, "
       "seq) AS job_no FROM postings"))
def _(spark, d):
    slim = base_postings(spark, d).select("job_id", "seq", "pay_min_annual", "pay_max_annual")
    return O.number_jobs(slim, O.sort_keys("pay")).select("job_id", F.col("job_no").cast("bigint").alias("job_no"))


@query("cap_jobs", over_postings("SELECT job_id FROM (SELECT job_id, seq FROM postings WHERE NOT promoted ORDER BY seq LIMIT 1000)"))
def _(spark, d):
    return O.cap_jobs(base_postings(spark, d).where("not promoted"), 1000).select("job_id")


@query("recent_log", "SELECT event_id, event_type AS line FROM events ORDER BY ts DESC, event_id LIMIT 300")
def _(spark, d):
    log = table(spark, d, "events").select("event_id", F.col("ts").alias("t"), F.col("event_type").alias("line"))
    return O.recent_log(log).select("event_id", "line")


@query("verdict_list", f"WITH {SQL_VERDICTS} SELECT job_id, verdict, row_number() OVER (ORDER BY CAST(job_id AS BIGINT) DESC) AS pos "
       "FROM verdicts")
def _(spark, d):
    listed = verdict_rows(spark, d)
    numbered = O.number_rows(listed, [F.col("at").desc(), "job_id"], "pos")
    return numbered.select("job_id", "verdict", F.col("pos").cast("bigint").alias("pos"))


# ---- facts in prose ----

_LO = "CAST(floor(o_totalprice) AS BIGINT)"
_HI = f"({_LO} + CAST(floor({_LO} / 4.0) AS BIGINT))"
_KLO, _KHI = f"(CAST(floor({_LO} / 1000.0) AS BIGINT) * 1000)", f"(CAST(floor({_HI} / 1000.0) AS BIGINT) * 1000)"
# "$401K" reads as the retirement plan, which is never pay: by design such a range yields nothing.
_K401 = f"({_KLO} = 401000 OR {_KHI} = 401000)"
# A range counts only when both ends are plausible; when the lower is not, the upper stands alone.
SQL_PAY = f"""
SELECT job_id, lo AS pay_min_annual, hi AS pay_max_annual, CASE WHEN lo IS NULL THEN '' WHEN kind = 3 THEN 'hour' ELSE 'year' END
 AS pay_period, CASE WHEN lo IS NULL THEN '' WHEN kind = 2 THEN 'USD' ELSE '$' END AS pay_currency FROM (
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderkey % 5 AS kind,
 CASE o_orderkey % 5
  WHEN 0 THEN CASE WHEN {_LO} >= 10000 THEN {_LO} WHEN {_HI} >= 10000 THEN {_HI} END
  WHEN 1 THEN CASE WHEN {_K401} THEN NULL WHEN {_KLO} >= 10000 THEN {_KLO} WHEN {_KHI} >= 10000 THEN {_KHI} END
  WHEN 2 THEN CASE WHEN {_LO} >= 10000 THEN {_LO} END
  WHEN 3 THEN CASE WHEN o_orderkey % 100 + 5 >= 7 THEN CAST((o_orderkey % 100 + 5) * 2080 AS BIGINT) END END AS lo,
 CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN {_LO} >= 10000 THEN {_HI} END
  WHEN 1 THEN CASE WHEN {_KLO} >= 10000 AND NOT {_K401} THEN {_KHI} END END AS hi
FROM orders)"""


@query("extract_pay", SQL_PAY)
def _(spark, d):
    pay = spread(prose(spark, d)).select("job_id", X.best_pay("description").alias("p"))
    return pay.select("job_id", "p.pay_min_annual", "p.pay_max_annual", "p.pay_period", "p.pay_currency")


@query("money_mentions", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END AS n,
 CAST(CASE o_orderkey % 5 WHEN 0 THEN {_LO} + {_HI} WHEN 1 THEN {_KLO} + {_KHI} WHEN 2 THEN {_LO}
  WHEN 3 THEN o_orderkey % 100 + 5 ELSE o_orderkey % 90 + 10 END AS DOUBLE) AS total FROM orders""")
def _(spark, d):
    m = X.mention_rows(spread(prose(spark, d)).withColumn("m", X.money_mentions("description")), F.col("m"), "job_id")
    return m.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("value").alias("total"))


SQL_YEARS = """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CAST(CASE o_orderkey % 4
 WHEN 1 THEN CASE WHEN o_orderkey % 30 <= 25 THEN o_orderkey % 30 END WHEN 2 THEN o_orderkey % 9 + 1 WHEN 3 THEN 7 END AS INTEGER)
 AS yoe_min FROM orders"""


@query("extract_years", SQL_YEARS)
def _(spark, d):
    y = spread(prose(spark, d)).withColumn("y", X.years_mentions("description"))
    return y.select("job_id", X.years_required("y").alias("yoe_min"))


@query("extract_flags", """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderkey % 11 = 0 AS needs_clearance,
 o_orderkey % 13 = 0 AS sponsorship_unavailable, o_orderkey % 17 = 0 AS requires_relocation, o_orderkey % 19 = 0 AS not_remote FROM orders""")
def _(spark, d):
    return spread(prose(spark, d)).select("job_id", *[X.flag("description", n).alias(n) for n in X.FLAGS])


@query("extract_travel_onsite", """SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
 CAST(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 130 <= 100 THEN o_orderkey % 130 END AS INTEGER) AS travel_pct,
 CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 6 + 1 END AS INTEGER) AS onsite_days_per_week FROM orders""")
def _(spark, d):
    return spread(prose(spark, d)).select("job_id", X.travel_pct("description").alias("travel_pct"),
                                  X.onsite_days("description").alias("onsite_days_per_week"))


@query("flag_snippets", """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END +
 CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END +
 CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS n, o_orderkey % 13 = 0 AS has_sponsor FROM orders""")
def _(spark, d):
    s = spread(prose(spark, d)).select("job_id", X.flag_snippets("description").alias("m"))
    got = F.try_element_at("m", F.lit("sponsorship_unavailable"))
    return s.select("job_id", F.size("m").alias("n"),
                    F.coalesce(F.contains(got, F.lit("cannot sponsor")), F.lit(False)).alias("has_sponsor"))


@query("facts_in_documents", """SELECT doc_id, CASE WHEN n_chars % 900 + 20 <> 401 THEN CAST(n_chars % 900 + 20 AS BIGINT) * 1000 END AS pay_min_annual,
 CAST(n_chars % 20 AS INTEGER) AS yoe_min, CAST(n_chars % 100 AS INTEGER) AS travel_pct FROM documents""")
def _(spark, d):
    n = F.col("n_chars")
    docs = spread(table(spark, d, "documents")).select("doc_id", F.concat(
        "text", F.lit("\nSalary $"), (n % 900 + 20).cast("string"), F.lit("K per year. " + CHARS_PAD), (n % 20).cast("string"),
        F.lit("+ years of experience. Travel up to "), (n % 100).cast("string"), F.lit("%.")).alias("description"))
    return X.extract_facts(docs).select("doc_id", "pay_min_annual", "yoe_min", "travel_pct")


# ---- structured hits ----

SQL_HITS = """live AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 10) AS BIGINT) AS page_no, * FROM part
 WHERE CAST(floor(p_partkey / 10) AS BIGINT) % 13 <> 5 AND CAST(floor(p_partkey / 10) AS BIGINT) % 11 <> 4)"""
_HIT_ID = "CASE WHEN k % 10 <> 3 THEN 'hit' || k WHEN k % 20 <> 13 THEN 'obj' || k END"
_NOW_MS = 1_700_000_000_000


@query("search_pages", """SELECT n AS page_no, CAST(CASE WHEN bad THEN 0 ELSE n_hits END AS INTEGER) AS n_hits,
 CASE WHEN bad THEN 0 ELSE n END AS page, CASE WHEN NOT bad THEN n * 7 END AS total, bad OR n % 5 = 0 AS last_page,
 CASE WHEN bad THEN 'no __NEXT_DATA__ pageProps' END AS error
 FROM (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS n, count(*) AS n_hits,
  CAST(floor(p_partkey / 10) AS BIGINT) % 13 = 5 OR CAST(floor(p_partkey / 10) AS BIGINT) % 11 = 4 AS bad FROM part GROUP BY ALL)""")
def _(spark, d):
    e = N.read_search_pages(search_pages(spark, d))
    return e.select("page_no", F.size("hits").alias("n_hits"), "page", "total", "last_page", "error")


def live_hits(spark, d):
    return N.drop_expired(N.explode_hits(N.read_search_pages(search_pages(spark, d))))


_Y = "(k % 4 = 0)"
_PMIN = (f"CASE WHEN k % 9 = 0 THEN NULL WHEN {_Y} THEN CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) "
         "WHEN k % 4 = 1 THEN CAST((p_size + 10) * 2080 AS BIGINT) END")
_PMAX = f"CASE WHEN k % 9 = 0 THEN NULL WHEN {_Y} AND k % 3 <> 0 THEN CAST(floor(p_retailprice * 100 + p_size + 0.5) AS BIGINT) END"


@query("normalise_hits", f"""WITH {SQL_HITS} SELECT {_HIT_ID} AS job_id,
 CASE WHEN k % 8 = 0 THEN 'Head of ' || p_name ELSE p_name END AS title,
 CASE WHEN k % 5 <> 0 THEN p_brand ELSE 'Co ' || p_brand END AS company, 'Town ' || (k % 50) AS location,
 CASE k % 5 WHEN 0 THEN 'On-site' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Remote' ELSE 'Unknown' END AS workplace_type,
 CASE WHEN k % 3 <> 0 THEN 'external' ELSE 'unknown' END AS apply_type,
 {_PMIN} AS pay_min_annual, {_PMAX} AS pay_max_annual,
 CASE WHEN k % 9 = 0 THEN '' WHEN {_Y} THEN 'hiringcafe:yearly' WHEN k % 4 = 1 THEN 'hiringcafe:hourly' ELSE '' END AS pay_source,
 CASE WHEN k % 3 = 0 AND k % 6 <> 0 THEN CAST(p_size % 20 AS INTEGER) END AS yoe_min,
 CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN FALSE END AS sponsorship_unavailable,
 CASE k % 4 WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS needs_clearance,
 CAST(greatest(floor(({_NOW_MS} - (1000000000000 + k * 3600000)) / 86400000.0), 0) AS INTEGER) AS posted_days_ago,
 CASE WHEN k % 7 <> 0 AND k % 4 <> 0 THEN 'Summary of ' || p_type || chr(10) || chr(10) || 'Tools and systems: ' || p_type
  WHEN k % 7 <> 0 THEN 'Summary of ' || p_type WHEN k % 4 <> 0 THEN 'Tools and systems: ' || p_type ELSE '' END AS description
FROM live WHERE k % 25 <> 7 AND ({_HIT_ID}) IS NOT NULL""")
def _(spark, d):
    n = N.normalise_hit(live_hits(spark, d), now_ms=_NOW_MS)
    return n.select("job_id", "title", "company", "location", "workplace_type", "apply_type", "pay_min_annual", "pay_max_annual",
                    "pay_source", "yoe_min", "sponsorship_unavailable", "needs_clearance", "posted_days_ago", "description")


@query("travel_of", f"""WITH {SQL_HITS}, t AS (SELECT {_HIT_ID} AS job_id, k % 5 AS a, CAST(floor(k / 2) AS BIGINT) % 4 AS l FROM live
 WHERE k % 25 <> 7) SELECT job_id, CAST(CASE WHEN a = 1 THEN 75 WHEN a = 2 OR l = 2 THEN 25
 WHEN l = 3 THEN NULL WHEN a = 0 OR l = 0 THEN 0 END AS INTEGER) AS travel_pct FROM t WHERE job_id IS NOT NULL""")
def _(spark, d):
    return N.normalise_hit(live_hits(spark, d), now_ms=_NOW_MS).select("job_id", "travel_pct")


@query("detail_text", """SELECT 'hit' || p_partkey AS job_id, CASE WHEN p_partkey % 7 = 2 THEN '' ELSE 'Full text of ' || p_name ||
 ' & more' || chr(10) || chr(10) || '- one' || chr(10) || '- two' END AS text FROM part WHERE p_partkey % 3 <> 1""")
def _(spark, d):
    return N.read_detail_json(details(spark, d))


@query("collect_structured", f"""WITH {SQL_HITS}, h AS (SELECT *, {_HIT_ID} AS job_id FROM live WHERE k % 25 <> 7)
 SELECT job_id, CASE WHEN k % 10 <> 3 AND k % 3 <> 1 AND k % 7 <> 2 THEN 'hiringcafe:full' WHEN k % 7 <> 0 THEN 'hiringcafe:summary'
 ELSE 'none' END AS description_source FROM h WHERE job_id IS NOT NULL""")
def _(spark, d):
    got = L.collect_structured(search_pages(spark, d), details(spark, d), now_ms=_NOW_MS)
    return got.select("job_id", "description_source")


@query("criteria", """SELECT c_custkey, c_mktsegment AS query, CASE c_custkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN
 upper(substr(c_name, 1, 2)) END AS country, CASE c_custkey % 5 WHEN 1 THEN 'Onsite' WHEN 2 THEN 'Remote' WHEN 3 THEN 'Hybrid'
 WHEN 4 THEN 'Remote,Hybrid' END AS workplaces, CASE WHEN c_custkey % 3 <> 0 THEN greatest(1, CAST(floor(c_custkey * 1000 / 86400.0 + 0.5)
 AS BIGINT)) END AS max_days FROM customer WHERE c_custkey % 6 <> 0""")
def _(spark, d):
    k = F.col("c_custkey")
    searches = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 6 != 0, F.col("c_mktsegment")).alias("keywords"),
        F.when(k % 4 == 0, " United States").when(k % 4 == 1, "uk").when(k % 4 == 2, F.col("c_name")).alias("location"),
        F.when(k % 5 == 4, "2,3").when(k % 5 > 0, (k % 5).cast("string")).alias("remote"),
        F.when(k % 3 != 0, F.concat(F.lit("r"), (k * 1000).cast("string"))).otherwise("any").alias("posted"))
    return N.criteria(searches).withColumn("workplaces", F.array_join("workplaces", ","))


@query("criteria_filter", over_postings(
    "SELECT job_id FROM postings WHERE contains(lower(concat_ws(' ', title, company, description)), 'building') AND "
    "coalesce(workplace_type, 'Unknown') IN ('Unknown', 'Remote', 'Hybrid') AND (posted_days_ago IS NULL OR posted_days_ago <= 1500)"))
def _(spark, d):
    return N.criteria_filter(base_postings(spark, d), {
        "query": "building", "workplaces": ["Remote", "Hybrid"], "max_days": 1500}).select("job_id")


# ---- page header facts ----

def headers(spark, d):
    """Header parts per posting, with the facts known from columns."""
    p = base_postings(spark, d)
    k = F.col("seq")
    work = F.when(F.col("workplace_type").isin("Remote", "Hybrid", "On-site"), F.col("workplace_type"))
    meta = F.concat_ws(
        " · ", F.col("company"), F.when(k % 4 != 0, F.col("location")),
        F.when(k % 5 != 0, F.concat(F.when(k % 7 == 0, "Reposted ").otherwise(""), (k % 50 + 1).cast("string"), F.lit(" "), F.when(
            k % 3 == 0, "days").when(k % 3 == 1, "weeks").otherwise("hours"), F.lit(" ago"))),
        F.when(k % 6 != 0, F.concat(F.lit("Over "), F.format_number(k % 5000, 0), F.lit(" applicants"))), F.when(k % 2 == 0, work))
    pills = F.array_compact(F.array(
        F.when(k % 3 == 0, "Full-time"), F.when(k % 2 == 1, F.lower(work)), F.when(k % 5 == 0, "Mid-Senior level"),
        F.when(k % 4 == 1, F.concat(F.lit("$"), (k % 80 + 20).cast("string"), F.lit("K/yr - $"), (k % 80 + 40).cast("string"), F.lit("K/yr")))))
    return p.select("job_id", "seq", "title", "company", "company_url", "description", meta.alias("meta_line"), pills.alias("pills"),
                    F.when(k % 9 == 0, "No longer accepting applications").alias("apply_notice"),
                    F.when(F.col("apply_type") == "easy_apply", "Easy Apply").when(F.col("apply_type") == "applied", "Applied").when(
                        F.col("apply_type") == "external", "Apply").alias("apply_text"),
                    F.coalesce("apply_url", F.lit("https://www.linkedin.com/x")).alias("apply_href"),
                    F.concat("title", F.when(k % 13 == 0, " Promoted").otherwise(""), F.when(k % 8 == 0, " Viewed").otherwise("")).alias("card_text"))


_WORK = "CASE WHEN workplace_type IN ('Remote', 'Hybrid', 'On-site') THEN workplace_type END"
_PILL = "seq % 4 = 1"


@query("page_facts", over_postings(f"""SELECT job_id, CASE WHEN seq % 4 <> 0 THEN location ELSE '' END AS location,
 coalesce({_WORK}, 'Unknown') AS workplace_type,
 CAST(CASE WHEN seq % 5 <> 0 THEN CASE seq % 3 WHEN 0 THEN seq % 50 + 1 WHEN 1 THEN (seq % 50 + 1) * 7 ELSE 0 END END AS INTEGER) AS posted_days_ago,
 seq % 5 <> 0 AND seq % 7 = 0 AS reposted, CASE WHEN seq % 6 <> 0 THEN CAST(seq % 5000 AS INTEGER) END AS applicants,
 seq % 13 = 0 AS promoted, seq % 8 = 0 AS viewed,
 CASE WHEN seq % 9 = 0 THEN 'closed' WHEN apply_type IN ('easy_apply', 'applied', 'external') THEN apply_type ELSE 'unknown' END AS apply_type,
 CASE WHEN seq % 9 <> 0 AND apply_type = 'external' AND apply_url IS NOT NULL THEN apply_url ELSE '' END AS apply_url,
 CASE WHEN seq % 3 = 0 THEN 'Full-time' ELSE '' END AS employment_type, CASE WHEN seq % 5 = 0 THEN 'Mid-Senior level' ELSE '' END AS seniority,
 CASE WHEN {_PILL} THEN CAST((seq % 80 + 20) * 1000 AS BIGINT) END AS pay_min_annual, CASE WHEN {_PILL} THEN 'pill' ELSE '' END AS pay_source,
 CAST(length(coalesce(description, '')) AS INTEGER) AS description_chars FROM postings"""))
def _(spark, d):
    return P.build_postings(spread(headers(spark, d))).select(
        "job_id", "location", "workplace_type", "posted_days_ago", "reposted", "applicants", "promoted", "viewed", "apply_type",
        "apply_url", "employment_type", "seniority", "pay_min_annual", "pay_source", "description_chars")


@query("remote_contradiction", """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderkey % 2 = 0 AND
 (o_orderkey % 19 = 0 OR o_orderkey % 7 = 0) AS remote_contradiction FROM orders""")
def _(spark, d):
    t = prose(spark, d).withColumn("w", F.when(F.col("seq") % 2 == 0, "Remote").otherwise("Hybrid"))
    return spread(t).select("job_id", H.remote_contradiction(
        "w", X.flag("description", "not_remote"), X.onsite_days("description")).alias("remote_contradiction"))


@query("pay_tag", over_postings("""SELECT job_id, CASE WHEN pay_min_annual IS NOT NULL THEN '$' || CASE WHEN pay_min_annual >= 1000 THEN
 CAST(floor(pay_min_annual / 1000.0 + 0.5) AS BIGINT) || 'k' ELSE CAST(pay_min_annual AS VARCHAR) END || CASE WHEN pay_max_annual IS NOT NULL
 THEN '-$' || CASE WHEN pay_max_annual >= 1000 THEN CAST(floor(pay_max_annual / 1000.0 + 0.5) AS BIGINT) || 'k' ELSE
 CAST(pay_max_annual AS VARCHAR) END ELSE '' END || '/yr (JD)' END AS tag FROM postings"""))
def _(spark, d):
    p = base_postings(spark, d)
    return p.select("job_id", H.pay_tag(F.lit("$"), F.col("pay_min_annual"), F.col("pay_max_annual"), F.lit("year"), F.lit("jd")).alias("tag"))


@query("company_text", "SELECT c_custkey, c_name AS company FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    shown = F.concat(F.col("c_name"), F.lit("  "), F.format_number(F.col("c_custkey") * 7, 0), F.lit(" followers"))
    return c.select("c_custkey", H.company_text(shown).alias("company"))


@query("looks_like_title", """SELECT doc_id, length(t) BETWEEN 3 AND 120 AND NOT regexp_matches(t, '\\?$') AS ok FROM
 (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents)""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", H.looks_like_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("ok"))


@query("job_id_from_href", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 5 WHEN 4 THEN CASE WHEN l_partkey >= 100000 THEN
 CAST(l_partkey AS VARCHAR) END WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_partkey AS VARCHAR) WHEN 2 THEN CAST(l_partkey AS VARCHAR) END AS job_id FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    k, n = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 5
    href = (F.when(n == 0, F.concat(F.lit("/jobs/view/"), k, F.lit("/?x=1"))).when(n == 1, F.concat(F.lit("/jobs/search?currentJobId="), k))
            .when(n == 2, F.concat(F.lit("https://b.example.com/go?a=1&jobId="), k)).when(n == 4, F.concat(F.lit("/jobs/"), k))
            .otherwise(F.concat(F.lit("/in/person-"), k)))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", H.job_id_from_href(href).alias("job_id"))


@query("host_label", """SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN lower(regexp_replace(regexp_extract(url,
 '^https?://([^/?#:]+)', 1), '^www\\.', '')) ELSE substr(url, 1, 40) END AS host FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.host_label("url").alias("host"))


@query("thin_jobs", over_postings("""SELECT job_id, CASE WHEN length(coalesce(description, '')) < 200 THEN 'description was ' ||
 length(coalesce(description, '')) || ' characters' END AS thin_reason FROM postings WHERE length(coalesce(description, '')) < 200"""))
def _(spark, d):
    return P.thin_jobs(base_postings(spark, d)).select("job_id", "thin_reason")


@query("field_audit", over_postings("""SELECT job_id, CASE WHEN length(coalesce(description, '')) <= 100 THEN 'description>100 (got ' ||
 length(coalesce(description, '')) || ')' ELSE '' END AS missing, CAST(length(title) AS INTEGER) AS title_length FROM postings"""))
def _(spark, d):
    a = P.field_audit(headers(spark, d))
    return a.select("job_id", F.array_join("missing", "; ").alias("missing"), "title_length")


@query("field_coverage", over_postings(" UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER (WHERE coalesce(CAST({c} AS VARCHAR), '') <> '') AS filled, count(*) AS total FROM postings"
    for c in ("workplace_type", "apply_type", "pay_min_annual", "description", "apply_url", "applicants"))))
def _(spark, d):
    return P.field_coverage(base_postings(spark, d), ["workplace_type", "apply_type", "pay_min_annual", "description", "apply_url", "applicants"])


@query("detail_matches_listing", over_postings("""SELECT job_id FROM postings WHERE seq % 3 <> 2 AND
 length(coalesce(description, '')) > 120 AND seq % 4 <> 1"""))
def _(spark, d):
    p = base_postings(spark, d)
    k = F.col("seq")
    det = p.select("job_id", F.when(k % 3 == 0, F.col("title")).when(k % 3 == 1, F.concat(F.lit("*"), F.upper("title"), F.lit(" (m/f)")))
                   .otherwise("Other").alias("title"), "description", F.when(k % 4 == 1, "999999999").when(k % 4 == 2, F.col("job_id")).alias("url_id"))
    return P.detail_matches_listing(det, p.select("job_id", "title")).select("job_id")


@query("pane_signature", """SELECT doc_id, lang || '|' || length(b) || '|' || substr(b, 1, 140) || '|' || right(b, 80) AS signature FROM
 (SELECT doc_id, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS b FROM documents)""")
def _(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", pane_signature("lang", "text").alias("signature"))


@query("norm_title", "SELECT part.p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')!'), '[^a-z0-9]+', ' ', 'g')) AS t FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", norm_title(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")!"))).alias("t"))


# ---- dedupe, memory, verdicts ----

def arrivals(spark, d):
    """Line items as arrivals of their order: many rows per id, in a definite order."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("job_id"), "l_partkey", "l_suppkey", "l_shipdate", F.struct(
        "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("seq"))


@query("dedupe_first", """SELECT job_id, l_partkey, l_suppkey FROM (SELECT CAST(l_orderkey AS VARCHAR) AS job_id, l_partkey, l_suppkey,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS r
 FROM lineitem) WHERE r = 1""")
def _(spark, d):
    return D.dedupe_first(arrivals(spark, d)).select("job_id", "l_partkey", "l_suppkey")


@query("dedupe_cluster", """SELECT dedup_key, CAST(min(o_orderkey) AS VARCHAR) AS job_id FROM (SELECT o_orderkey, o_custkey || '-' ||
 o_orderpriority AS dedup_key FROM orders) GROUP BY dedup_key""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderkey").alias("seq"),
                                         F.concat_ws("-", "o_custkey", "o_orderpriority").alias("dedup_key"))
    return D.dedupe_first(o, on="dedup_key").select("dedup_key", "job_id")


@query("duplicate_guard", """WITH n AS (SELECT doc_id, trim(regexp_replace(text, '[\\s ]+', ' ', 'g')) AS t FROM documents)
 SELECT CAST(doc_id AS VARCHAR) AS job_id, CAST(owner AS VARCHAR) AS owner_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS owner
 FROM n WHERE length(t) >= 200) WHERE owner <> doc_id""")
def _(spark, d):
    docs = spread(table(spark, d, "documents")).select(
        F.col("doc_id").cast("string").alias("job_id"), F.col("doc_id").alias("seq"), F.col("text").alias("description"))
    return D.split_duplicates(docs)[1].select("job_id", "owner_id")


@query("duplicate_guard_batches", ORACLES["duplicate_guard"])
def _(spark, d):
    # Three batches one after the other, the owners folded between them, the second one once more: the same rows as at once.
    docs = spread(table(spark, d, "documents")).select(
        F.col("doc_id").cast("string").alias("job_id"), F.col("doc_id").alias("seq"), F.col("text").alias("description"))
    path, third = scratch(spark, "owners"), F.expr(f"seq * 3 div ({docs.agg(F.coalesce(F.max('seq'), F.lit(0))).first()[0]} + 1)")

    def batch(part: int) -> DataFrame:
        return OW.guard_batch(docs.where(third == part), path).where("owner_id is not null").select("job_id", "owner_id")

    first, second = batch(0), batch(1)
    OW.fold_owners(spark, path)
    return first.unionAll(second.intersectAll(batch(1))).unionAll(batch(2))


_IDENT = "'job' || lpad(CAST(doc_id AS VARCHAR), 7, '0')"


@query("verdict_lines", f"""SELECT {_IDENT} AS job_id, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS verdict,
 CASE doc_id % 4 WHEN 0 THEN 'reason ' || toxic WHEN 1 THEN 'because' ELSE 'short' END AS reason,
 CASE WHEN doc_id % 4 = 0 THEN 'strict' ELSE 'loose' END AS confidence FROM labels WHERE doc_id % 4 <> 3
 UNION ALL SELECT {_IDENT}, 'reject', 'changed', 'strict' FROM labels WHERE doc_id % 12 = 0""")
def _(spark, d):
    return V.parse_verdicts(V.read_chat_lines(chats(spark, d))).select("job_id", "verdict", "reason", "confidence")


@query("verdicts_latest", f"""SELECT {_IDENT} AS job_id, CASE WHEN doc_id % 12 = 0 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'reject' END
 AS verdict, CASE WHEN doc_id % 12 = 0 THEN 'changed' WHEN doc_id % 4 = 0 THEN 'reason ' || toxic WHEN doc_id % 4 = 1 THEN 'because' ELSE 'short' END AS reason
 FROM labels WHERE doc_id % 4 <> 3""")
def _(spark, d):
    lines = V.read_chat_lines(chats(spark, d))
    return V.latest_verdict(V.parse_verdicts(lines)).select("job_id", "verdict", "reason")


@query("ambiguous_lines", f"""SELECT 'VERDICT ' || {_IDENT} || ' ' || {_IDENT} || CASE WHEN quality = 1 THEN ' ACCEPT' ELSE ' REJECT' END AS line
 FROM labels WHERE doc_id % 4 = 3""")
def _(spark, d):
    return V.ambiguous_lines(V.read_chat_lines(chats(spark, d))).select("line")


@query("chat_lines", """SELECT conv_id, turn, trim(l) AS line FROM (SELECT conv_id, turn, unnest(string_split(replace(text, chr(13) || chr(10),
 chr(10)), chr(10))) AS l FROM conversations) WHERE trim(l) <> ''""")
def _(spark, d):
    return V.read_chat_lines(table(spark, d, "conversations")).select("conv_id", "turn", "line")


@query("verdict_token_report", f"""WITH t AS (SELECT doc_id % 97 + 1000000 AS conv_id, doc_id AS turn, 1 AS n, 'VERDICT ' || {_IDENT} ||
 CASE WHEN doc_id % 4 = 3 THEN ' ' || {_IDENT} ELSE '' END || CASE WHEN quality = 1 THEN ' ACCEPT' ELSE ' REJECT' END ||
 CASE WHEN doc_id % 4 = 0 THEN ': reason ' || toxic ELSE '' END AS line FROM labels WHERE doc_id % 4 IN (0, 3)
 UNION ALL SELECT doc_id % 97 + 1000000, doc_id, 2, 'VERDICT ' || {_IDENT} || ' REJECT: changed' FROM labels WHERE doc_id % 12 = 0)
 SELECT line FROM t ORDER BY conv_id, turn, n LIMIT 10""")
def _(spark, d):
    return V.verdict_token_report(V.read_chat_lines(chats(spark, d))).select("line")


def _store(spark, d):
    """An older verdict store: every second labelled document and some unlabelled ones."""
    docs = table(spark, d, "documents").where("doc_id % 2 = 0")
    return docs.select(F.col("doc_id").cast("string").alias("job_id"), F.lit("accept").alias("verdict"), F.lit("old").alias("reason"),
                       F.timestamp_seconds(F.lit(1_600_000_000)).alias("at"), F.lit("chat").alias("source"))


@query("merge_verdicts", f"""WITH {SQL_VERDICTS} SELECT coalesce(v.job_id, o.job_id) AS job_id, coalesce(v.verdict, 'accept') AS verdict,
 coalesce(v.reason, 'old') AS reason FROM (SELECT CAST(doc_id AS VARCHAR) AS job_id FROM documents WHERE doc_id % 2 = 0) o
 FULL JOIN verdicts v ON o.job_id = v.job_id""")
def _(spark, d):
    return V.merge_verdicts(_store(spark, d), verdict_rows(spark, d))[0].select("job_id", "verdict", "reason")


@query("merge_verdict_counts", """SELECT count(*) FILTER (WHERE o.doc_id IS NULL) AS added, count(*) FILTER (WHERE o.doc_id IS NOT NULL AND
 v.doc_id IS NOT NULL) AS updated, count(*) AS total FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) o FULL JOIN labels v USING (doc_id)""")
def _(spark, d):
    return V.merge_verdicts(_store(spark, d), verdict_rows(spark, d))[1]


@query("history_newest", """SELECT CAST(o_custkey AS VARCHAR) AS job_id, epoch_ms(max(o_orderdate)) AS at_ms FROM orders GROUP BY o_custkey""")
def _(spark, d):
    h = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("exported_at"))
    return M.newest(h, "job_id", "exported_at").select("job_id", F.unix_millis("exported_at").alias("at_ms"))


@query("history_folded", """SELECT CAST(o_custkey AS VARCHAR) AS job_id, epoch_ms(max(o_orderdate)) AS at_ms FROM orders GROUP BY o_custkey
 HAVING o_custkey % 5 <> 0 OR max(o_orderdate) > DATE '1997-01-01'""")
def _(spark, d):
    # Three writes, then every fifth customer is forgotten as of 1997; the writes are folded, and the first one lands again afterwards.
    h = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("exported_at"), "o_orderkey", "o_custkey")
    path, parts = scratch(spark, "history"), [h.where(F.col("o_orderkey") % 3 == k).select("job_id", "exported_at") for k in range(3)]
    for part in parts:
        M.upsert_memory(part, path)
    M.forget(h.where("o_custkey % 5 = 0").select("job_id").distinct(), path, HISTORY, "job_id", "exported_at", "1997-01-01")
    M.fold_memory(spark, path, HISTORY, "job_id", "exported_at")
    M.upsert_memory(parts[0], path)
    return M.read_memory(spark, path, HISTORY, "job_id", "exported_at").select("job_id", F.unix_millis("exported_at").alias("at_ms"))


@query("tag_rows", f"""WITH {SQL_POSTINGS}, {SQL_HISTORY}, {SQL_VERDICTS} SELECT p.job_id, h.job_id IS NOT NULL AS seen, v.verdict, v.reason
 FROM postings p LEFT JOIN history h ON p.job_id = h.job_id LEFT JOIN verdicts v ON p.job_id = v.job_id""")
def _(spark, d):
    return L.tag_rows(base_postings(spark, d), history(spark, d), verdict_rows(spark, d)).select("job_id", "seen", "verdict", "reason")


@query("skip_known", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    known = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"))
    return D.skip_known(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_id")), known)


@query("union_sources", f"""WITH {SQL_POSTINGS}, {SQL_HITS} SELECT job_id, 'board' AS source, remote_contradiction FROM postings UNION ALL
 SELECT {_HIT_ID}, 'hiringcafe', FALSE FROM live WHERE k % 25 <> 7 AND ({_HIT_ID}) IS NOT NULL""")
def _(spark, d):
    both = union_postings(base_postings(spark, d), N.normalise_hit(live_hits(spark, d), now_ms=_NOW_MS))
    return both.select("job_id", "source", "remote_contradiction")


# ---- runs ----

def outcomes(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), "collected").when(F.col("event_type") == "signup", "skipped").otherwise("failed")
    return e.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), (F.col("event_id") % 40 + 1).alias("page_no"),
                    kind.alias("outcome"), F.when(F.col("event_type") == "error", F.concat(F.lit("reason "), (F.col("event_id") % 7).cast("string"))).alias("reason"),
                    F.col("event_id").alias("seq"))


@query("run_summary", """SELECT 'run' || user_id AS run_id, count(*) FILTER (WHERE event_type IN ('view', 'click', 'purchase')) AS collected,
 count(*) FILTER (WHERE event_type = 'signup') AS skipped, count(*) FILTER (WHERE event_type = 'error') AS failed,
 max(event_id % 40 + 1) AS pages_done, 'reason ' || (max(event_id) FILTER (WHERE event_type = 'error') % 7) AS reason FROM events GROUP BY user_id""")
def _(spark, d):
    return R.run_summary(outcomes(spark, d))


def stages(spark, d):
    """Eight-stage records per event: each job reaches a stage given by its value and fails there or ends well."""
    e = table(spark, d, "events")
    reach = F.least(F.col("event_id") % 11, F.lit(7)).cast("int")
    bad = F.col("event_type") == "error"
    name = F.array(*[F.lit(s) for s in R.STAGES])
    return e.select(F.col("event_id").cast("string").alias("job_id"), bad.alias("bad"), reach.alias("reach"),
                    F.explode(F.sequence(F.lit(0), reach)).alias("ord")).select(
        "job_id", "ord", F.get(name, F.col("ord")).alias("stage"),
        F.when(F.col("bad") & (F.col("ord") == F.col("reach")), "failed").otherwise("ok").alias("status"),
        F.when(F.col("bad") & (F.col("ord") == F.col("reach")), F.concat(F.lit("at "), F.col("ord").cast("string"))).alias("reason"))


_STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in R.STAGES) + "]"


@query("stage_funnel", f"""WITH s AS (SELECT event_type, least(event_id % 11, 7) AS reach, unnest(range(0, 8)) AS ord FROM events)
 SELECT {_STAGE_LIST}[ord + 1] AS stage, count(*) AS reached, CAST(sum(CASE WHEN event_type = 'error' AND ord = reach THEN 1 ELSE 0 END) AS BIGINT)
 AS stopped, CAST(ord + 1 AS INTEGER) AS stage_no FROM s WHERE ord <= reach GROUP BY ord""")
def _(spark, d):
    return R.stage_funnel(stages(spark, d))


@query("first_failures", f"""SELECT CAST(event_id AS VARCHAR) AS job_id, {_STAGE_LIST}[least(event_id % 11, 7) + 1] AS stage,
 'at ' || least(event_id % 11, 7) AS reason FROM events WHERE event_type = 'error'""")
def _(spark, d):
    return R.first_failures(stages(spark, d))


def shown_cards(spark, d):
    """What each run saw page by page: a page is one order's parts, a run is one customer."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    page = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint")
    numbered = o.select("o_orderkey", F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("run_id"), page.alias("page_no"))
    return li.join(numbered, li.l_orderkey == numbered.o_orderkey).select("run_id", "page_no", (F.col("l_partkey") % 50).cast("string").alias("job_id"))


_CARDS = """n AS (SELECT o_orderkey, 'run' || o_custkey AS run_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no FROM orders),
 cards AS (SELECT run_id, page_no, CAST(l_partkey % 50 AS VARCHAR) AS job_id FROM lineitem JOIN n ON l_orderkey = o_orderkey),
 firsts AS (SELECT run_id, job_id, min(page_no) AS page_no FROM cards GROUP BY ALL),
 pp AS (SELECT c.run_id, c.page_no, any_value(c.n) AS cards, count(f.job_id) AS new_ids FROM (SELECT run_id, page_no, count(*) AS n FROM cards
  GROUP BY ALL) c LEFT JOIN firsts f ON c.run_id = f.run_id AND c.page_no = f.page_no GROUP BY c.run_id, c.page_no)"""


@query("new_ids_per_page", f"WITH {_CARDS} SELECT * FROM pp")
def _(spark, d):
    return R.new_ids_per_page(shown_cards(spark, d))


@query("barren_streak", f"""WITH {_CARDS} SELECT r.run_id, s.stop_page FROM (SELECT DISTINCT run_id FROM pp) r LEFT JOIN (SELECT a.run_id,
 min(a.page_no) AS stop_page FROM pp a JOIN pp b ON a.run_id = b.run_id AND b.page_no = a.page_no - 1 WHERE a.new_ids = 0 AND b.new_ids = 0
 GROUP BY a.run_id) s ON r.run_id = s.run_id""")
def _(spark, d):
    return R.barren_streak(R.new_ids_per_page(shown_cards(spark, d)))


@query("ids_per_page_check", """SELECT page_id, cards, distinct_ids, (distinct_ids = 0) OR (cards >= 3 AND distinct_ids < greatest(2, ceil(cards * 0.6)))
 AS by_position FROM (SELECT l_orderkey AS page_id, count(*) AS cards, count(DISTINCT l_suppkey % 4) AS distinct_ids FROM lineitem GROUP BY l_orderkey)""")
def _(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_suppkey") % 4).cast("string").alias("job_id"))
    return R.ids_per_page_check(c)


# ---- export ----

@query("job_blocks", over_postings("""SELECT job_id, '--- JOB ' || (row_number() OVER (ORDER BY seq)) || ' | ID ' || job_id || ' ---' AS head,
 'Location: ' || location || ' (' || coalesce(workplace_type, '') || ')' AS place, 'Applicants: ' || coalesce(CAST(applicants AS VARCHAR), 'unknown') AS applied,
 concat_ws(' | ', 'Years required: ' || yoe_min || '+', 'Travel: up to ' || travel_pct || '%', CASE WHEN needs_clearance THEN 'Security clearance required' END,
 CASE WHEN sponsorship_unavailable THEN 'Visa sponsorship NOT available' END, CASE WHEN requires_relocation THEN 'Relocation required' END,
 CASE WHEN remote_contradiction THEN 'WARNING: tagged Remote but the description requires onsite presence' END, 'Direct apply URL: ' || apply_url) AS facts,
 length(coalesce(description, '(no description captured)')) AS text_chars FROM postings"""))
def _(spark, d):
    b = E.with_blocks(postings(spark, d))
    line = lambda n: F.split_part("block", F.lit("\n"), F.lit(n))
    text = F.regexp_extract("block", "(?s)JOB DESCRIPTION:\n(.*)\n\\z", 1)
    return b.select("job_id", line(1).alias("head"), line(4).alias("place"), line(6).alias("applied"),
                    F.regexp_extract("block", "PARSED FACTS: ([^\n]*)", 1).alias("facts"),
                    F.length(text).cast("bigint").alias("text_chars"))


_GREEDY = """WITH RECURSIVE r AS (SELECT o_orderkey AS k, {grp} AS g, CAST(floor(o_totalprice / 60) AS BIGINT) AS len,
 row_number() OVER (PARTITION BY {grp} ORDER BY o_orderkey) AS i FROM orders),
 walk AS (SELECT g, k, i, len AS used, 1 AS cnt, CAST(1 AS BIGINT) AS batch_no FROM r WHERE i = 1
 UNION ALL SELECT r.g, r.k, r.i, CASE WHEN used + r.len > 20000 OR cnt >= 15 THEN r.len ELSE used + r.len END,
 CASE WHEN used + r.len > 20000 OR cnt >= 15 THEN 1 ELSE cnt + 1 END, CASE WHEN used + r.len > 20000 OR cnt >= 15 THEN batch_no + 1 ELSE batch_no END
 FROM walk JOIN r ON r.g = walk.g AND r.i = walk.i + 1)
 SELECT CAST(k AS VARCHAR) AS job_id, {out}batch_no FROM walk"""


def _lengths(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderkey").alias("job_no"),
        (F.col("o_custkey") % 40).cast("string").alias("export_id"), F.floor(F.col("o_totalprice") / 60).cast("bigint").alias("len"))


@query("pack_batches", _GREEDY.format(grp="0", out=""))
def _(spark, d):
    return E.pack_batches(_lengths(spark, d), ["job_no"], 20_000, length=F.col("len")).select("job_id", "batch_no")


@query("pack_batches_grouped", _GREEDY.format(grp="o_custkey % 40", out="CAST(g AS VARCHAR) AS export_id, "))
def _(spark, d):
    return E.pack_batches(_lengths(spark, d), ["job_no"], 20_000, group="export_id", length=F.col("len"), chunk_rows=4096).select(
        "job_id", "export_id", "batch_no")


# Blocks here are far below the budget, so only the fifteen-job limit cuts.
@query("render_batches", over_postings("""SELECT batch_no, (n + 14) // 15 AS n_batches, count(*) AS n_jobs, '=== BATCH ' || batch_no || ' of ' || ((n + 14) // 15) ||
 ' — ' || count(*) || ' jobs ===' AS head, string_agg(job_id, ',' ORDER BY r) AS ids FROM (SELECT job_id, r, n, (r - 1) // 15 + 1 AS batch_no FROM (SELECT job_id,
 row_number() OVER (ORDER BY coalesce(pay_max_annual, pay_min_annual, -1) DESC, seq) AS r, count(*) OVER () AS n FROM postings WHERE NOT promoted)) GROUP BY batch_no, n"""))
def _(spark, d):
    batches = L.export_batches(postings(spark, d), FL.FilterSpec(sort="pay", no_promoted=True))
    found = F.regexp_extract_all("text", F.lit("--- JOB \\d+ [|] ID (\\d+) ---"), F.lit(1))
    return batches.select("batch_no", "n_batches", "n_jobs", F.regexp_extract("text", "=== BATCH .*? ===", 0).alias("head"),
                          F.array_join(found, ",").alias("ids"))


@query("batch_totals", over_postings("""SELECT CAST(count(DISTINCT batch_no) AS BIGINT) AS batches, count(*) AS jobs FROM (
 SELECT (row_number() OVER (ORDER BY seq) + 14) // 15 AS batch_no FROM postings)"""))
def _(spark, d):
    blocks = E.with_blocks(postings(spark, d))
    return E.batch_totals(E.render_batches(blocks, E.pack_batches(blocks, ["job_no"]))).select("batches", "jobs")


@query("csv_cells", """SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell
 FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", csv_cell("text").alias("cell"))


# ---- pages ----

_T = r"regexp_replace({0}, '{1}', {2}, 'g')"


def _html_sql() -> str:
    blocks = ("address|article|aside|blockquote|div|dl|dd|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|main|nav|ol|p|pre"
              "|section|table|tbody|td|tfoot|th|thead|tr|ul")
    s = "html"
    for tag in ("script", "style", "noscript"):
        s = _T.format(s, f"(?is)<{tag}\\b.*?</{tag}>", "' '")
    steps = [("(?s)<!--.*?-->", "' '"), ("(?i)<br\\s*/?>", "chr(10)"), ("(?i)<li\\b[^>]*>", "chr(10) || '- '"), ("(?i)</li\\s*>", "''"),
             (f"(?i)<(?:{blocks})\\b[^>]*>", "chr(10)"), (f"(?i)</(?:{blocks})\\s*>", "chr(10)"), ("<[^>]+>", "''")]
    for p, r in steps:
        s = _T.format(s, p, r)
    for name, ch in (("&quot;", "chr(34)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        s = f"replace({s}, '{name}', {ch})"
    for p, r in ((r"\r", "''"), (r"[ \t\x{00A0}]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"),
                 (r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "''")):
        s = _T.format(s, p, r)
    return f"SELECT page_id, {s} AS text FROM pages"


@query("html_text", _html_sql())
def _(spark, d):
    return spread(table(spark, d, "pages")).select("page_id", html_to_text("html").alias("text"))


def parsed_pages(spark, d):
    return B.html_blocks(spread(table(spark, d, "pages")))


@query("page_links", """SELECT page_id, len(regexp_extract_all(body, '(?i)<a\\s[^>]*href=')) AS n_links FROM (SELECT page_id,
 regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS body FROM pages)""")
def _(spark, d):
    n = F.size(F.filter("els", lambda e: (e["tag"] == "a") & F.map_contains_key(e["attrs"], "href")))
    return parsed_pages(spark, d).select("page_id", n.cast("bigint").alias("n_links"))


@query("html_blocks", """SELECT page_id, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?is)(<script\\b[^>]*>).*?</script>', '\\1', 'g'),
 '(?is)(<style\\b[^>]*>).*?</style>', '\\1', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[a-zA-Z][^<>]*>')) AS elements FROM pages""")
def _(spark, d):
    rows = B.block_rows(parsed_pages(spark, d))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("elements"))


@query("page_outlines")
def _(spark, d):
    return OL.page_outline(parsed_pages(spark, d)).select("page_id", F.length("outline").alias("chars"), F.md5("outline").alias("md5"))


@query("outline_lines", """SELECT CAST(s_suppkey AS INTEGER) AS page_id, 'main' || chr(10) || '  ul.list' || chr(10) || '    li  "a"' ||
 CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE chr(10) || '    … ×' || (s_suppkey % 4) || ' more siblings of the same shape' END ||
 chr(10) || '  p#p' || s_suppkey || '  "end"' AS outline FROM supplier""")
def _(spark, d):
    # A run of 1 to 4 same-shaped siblings: from three on, one line stands for all but the first.
    k = F.col("s_suppkey").cast("int")
    items = F.concat(F.lit("<li>a</li>"), F.repeat(F.lit("<li>b</li>"), k % 4))
    html = F.concat(F.lit('<main><ul class="list">'), items, F.lit('</ul><p id="p'), k.cast("string"), F.lit('">end</p><script>x</script></main>'))
    pages = table(spark, d, "supplier").select(k.alias("page_id"), F.lit("https://b.example.com/jobs").alias("url"), html.alias("html"))
    return OL.page_outline(B.html_blocks(pages))


@query("page_digests", """SELECT CAST(s_suppkey AS INTEGER) AS page_id, '  elements carrying a job id: 5 (4 distinct ids)' AS ids, '  cards: 4' AS cards,
 'query params: page, sort' AS params FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey").cast("int")
    link = lambda i: F.concat(F.lit('<li><a href="/jobs/view/'), (k * 10 + i).cast("string"), F.lit('/">Harbour pilot</a></li>'))
    html = F.concat(F.lit("<main><ul>"), *map(link, (1, 2, 3, 4, 4)), F.lit("</ul></main>"))
    pages = table(spark, d, "supplier").select(k.alias("page_id"), F.lit("https://b.example.com/jobs?page=2&sort=new").alias("url"), html.alias("html"))
    lines = F.split("digest", "\n")
    pick = lambda start: F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(start))), F.lit(0))
    return OL.page_digest(B.html_blocks(pages)).select("page_id", pick("  elements").alias("ids"), pick("  cards").alias("cards"), pick("query params").alias("params"))


@query("static_blocks")
def _(spark, d):
    return B.static_blocks(parsed_pages(spark, d))


def parsed_board(spark, d, marker="reliable"):
    return B.html_blocks(spread(board_pages(spark, d, marker)))


_SHOWN = """shown AS (SELECT *, CAST(floor(seq / 10) AS BIGINT) AS page_id, row_number() OVER (PARTITION BY floor(seq / 10) ORDER BY seq) AS r FROM postings)"""


@query("job_links", over_postings("SELECT CAST(floor(seq / 10) AS BIGINT) AS page_id, job_id, CAST(2 AS BIGINT) AS elements FROM postings"))
def _(spark, d):
    return B.job_links(parsed_board(spark, d)).groupBy("page_id", "job_id").agg(F.count(F.lit(1)).alias("elements"))


@query("discovery_breakdown", """SELECT p AS pattern, CASE WHEN p IN ('a[href*="/jobs/view/"]', '[data-job-id]') THEN (SELECT count(*) FROM orders) ELSE 0 END AS n FROM (SELECT unnest([
 'a[href*="/jobs/view/"]', 'a[href*="currentJobId="]', 'a[href*="jobId="]', '[data-occludable-job-id]', '[data-job-id]', '[data-jobid]',
 '[data-entity-urn*="jobPosting"]', '[data-urn*="jobPosting"]', '[data-tracking-urn*="jobPosting"]']) AS p)""")
def _(spark, d):
    return B.discovery_breakdown(parsed_board(spark, d))


@query("list_roots", over_postings("SELECT CAST(floor(seq / 10) AS BIGINT) AS page_id, 'ul' AS tag, CAST(count(*) AS INTEGER) AS n_children FROM postings GROUP BY 1"))
def _(spark, d):
    return B.list_root(parsed_board(spark, d)).select("page_id", "root.tag", "root.n_children")


@query("cards", over_postings("SELECT CAST(floor(seq / 10) AS BIGINT) AS page_id, job_id, CAST(row_number() OVER (PARTITION BY floor(seq / 10) ORDER BY seq) - 1 "
       "AS INTEGER) AS card_no FROM postings"))
def _(spark, d):
    return B.cards(parsed_board(spark, d)).select("page_id", "job_id", "card_no")


@query("repeated_groups", over_postings("SELECT CAST(floor(seq / 10) AS BIGINT) AS page_id, 'LI:2' AS shape, count(*) AS members FROM postings GROUP BY 1"))
def _(spark, d):
    groups = B.job_list_check(B.repeated_groups(parsed_board(spark, d)))
    return B.best_group(groups).select("page_id", "shape", "members")


@query("turn_groups", over_postings("""SELECT CAST(floor(seq / 10) AS BIGINT) AS page_id, 'LI:2' AS shape, count(*) AS members FROM postings
 GROUP BY 1 HAVING count(*) >= 2 UNION ALL SELECT DISTINCT CAST(floor(seq / 10) AS BIGINT), 'LI:0', 2 FROM postings"""))
def _(spark, d):
    return B.turn_groups(parsed_board(spark, d)).select("page_id", "shape", "members")


@query("page_parts", f"""WITH {SQL_POSTINGS}, {_SHOWN} SELECT page_id, title, company, location || ' · ' || coalesce(posted_days_ago, 1) || ' days ago · ' ||
 coalesce(applicants, 3) || ' applicants' AS meta_line, 'heading' AS desc_via, CASE apply_type WHEN 'easy_apply' THEN 'Easy Apply' WHEN 'external' THEN 'Apply' END AS apply_text,
 '{CHARS_PAD.strip()} We want reliable people.' || chr(10) || chr(10) || '- Salary $' || format('{{:,}}', coalesce(pay_min_annual, 50000) + 10000) || ' per year' || chr(10) || '- 3+ years of experience' AS description
 FROM shown WHERE r = 1""")
def _(spark, d):
    return B.page_parts(parsed_board(spark, d)).select("page_id", "title", "company", "meta_line", "desc_via", "apply_text", "description")


@query("collect_from_pages", f"""WITH {SQL_POSTINGS}, {_SHOWN} SELECT page_id, title, company, location, coalesce(workplace_type, 'Unknown') AS workplace_type,
 coalesce(posted_days_ago, 1) AS posted_days_ago, coalesce(applicants, 3) AS applicants, 'Full-time' AS employment_type,
 CASE WHEN apply_type IN ('easy_apply', 'external') THEN apply_type ELSE 'unknown' END AS apply_type, coalesce(pay_min_annual, 50000) + 10000 AS pay_min_annual, 3 AS yoe_min
 FROM shown WHERE r = 1""")
def _(spark, d):
    pages = spread(board_pages(spark, d)).withColumn("job_id", F.col("page_id").cast("string"))
    built = L.collect_pages(pages, "page_id")
    return built.select(F.col("job_id").cast("bigint").alias("page_id"), "title", "company", "location", "workplace_type", "posted_days_ago",
                        "applicants", "employment_type", "apply_type", "pay_min_annual", "yoe_min")


@query("wide_descriptions", over_postings("SELECT DISTINCT CAST(floor(seq / 10) AS BIGINT) AS page_id, 'h2 \"About the job\", sibling' AS wide_via FROM postings"))
def _(spark, d):
    return B.header_region(parsed_board(spark, d)).select("page_id", "wide_via")


# ---- routes that a page takes when its usual parts are missing ----

BODY = f"<p>{(CHARS_PAD * 3).strip()}</p>"


def page_of(html: str, **parts: Column) -> Column:
    """HTML with ``{name}`` replaced by a part or a column of the same name."""
    out = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", html)):
        out.append(F.lit(piece) if k % 2 == 0 else parts[piece] if piece in parts else F.col(piece).cast("string"))
    return F.concat(*out)


def parsed_postings(spark, d, html: str, path: str = "/jobs/search", **parts: Column):
    """A parsed page per posting."""
    p = base_postings(spark, d)
    return B.html_blocks(spread(p.select("job_id", "seq", F.lit(f"https://board.example.com{path}").alias("url"), page_of(html, **parts).alias("html"))))


@query("description_routes", over_postings("""SELECT job_id, CASE seq % 3 WHEN 0 THEN 'heading' WHEN 2 THEN 'dense' END AS desc_via,
 CASE WHEN seq % 3 <> 1 THEN 'd' || seq END AS block FROM postings"""))
def _(spark, d):
    # A label with the text next to it; no label and too little text; no label, so the deepest of the blocks that hold nearly all text.
    k = F.col("seq") % 3
    html = ('<html><body><main><div class="rail"><ul><li><a href="/jobs/view/{job_id}/">One</a></li><li><a href="/jobs/view/9{job_id}/">Two</a></li></ul></div>'
            '<section><div>{label}<div id="d{seq}">{body}</div></div><p>{company}</p></section></main></body></html>')
    parsed = parsed_postings(spark, d, html, label=F.when(k == 0, "<h2>Job description</h2>").otherwise(""), body=F.when(k == 1, "<p>Short.</p>").otherwise(BODY))
    found = B.description_of_page(parsed)
    return found.select("job_id", "desc_via", F.try_element_at("desc.attrs", F.lit("id")).alias("block"))


@query("wide_routes", over_postings("""SELECT job_id, CASE seq % 5 WHEN 0 THEN 'largest block in the pane (no heading)' WHEN 1 THEN 'heading, about-the-job family, sibling'
 WHEN 2 THEN 'heading, job-description, ancestor +2' WHEN 3 THEN 'heading, description, sibling' ELSE 'h2 "About the job", sibling' END AS wide_via,
 'd' || seq AS block, 't' || seq AS region FROM postings"""))
def _(spark, d):
    # All four tiers of labels, text beside or above the label, or sheer bulk; the header around the posting's link.
    k = F.col("seq") % 5
    label = F.when(k == 1, "<h3>About the role</h3>").when(k == 3, "<h4>Description</h4>").when(k == 4, "<h2>About the job</h2>").otherwise("")
    block = F.when(k == 0, page_of('<div><p id="d{seq}">' + BODY[3:])).when(
        k == 2, page_of('<div id="d{seq}"><div><h2>Role description</h2></div><div>' + BODY + "</div>")).otherwise(page_of('<div id="d{seq}">' + BODY))
    html = ('<html><body><main><div><div id="t{seq}"><a href="/jobs/view/{job_id}/">{title}</a><span>{company} is an employer in a large city far away</span></div>'
            "<section>{label}{block}</div></section></div></main></body></html>")
    found = B.header_region(parsed_postings(spark, d, html, label=label, block=block))
    ident = lambda c: F.try_element_at(f"{c}.attrs", F.lit("id"))
    return found.select("job_id", "wide_via", ident("wide").alias("block"), ident("region").alias("region"))


@query("header_fallbacks", over_postings("""SELECT job_id, CAST(CASE WHEN seq % 4 = 0 THEN NULL WHEN seq % 2 = 0 THEN (seq % 11 + 1) * 30 ELSE (seq % 2 + 1) * 365 END AS INTEGER) AS posted_days_ago,
 CASE WHEN seq % 4 <> 0 THEN CAST(seq % 900 + 1000 AS INTEGER) END AS applicants, CASE WHEN seq % 4 = 0 THEN 'Remote' WHEN seq % 3 = 0 THEN 'Hybrid' WHEN seq % 3 = 1 THEN 'On-site' ELSE 'Remote' END AS workplace_type,
 seq % 4 <> 0 AND seq % 5 = 0 AS reposted FROM postings"""))
def _(spark, d):
    # The meta line states a place only; age, applicants and workplace stand in the header's text, or the place says remote.
    k = F.col("seq")
    age = F.when(k % 2 == 0, F.concat((k % 11 + 1).cast("string"), F.lit(" months ago"))).otherwise(F.concat((k % 2 + 1).cast("string"), F.lit(" years ago")))
    word = F.when(k % 3 == 0, "hybrid").when(k % 3 == 1, "ON-SITE").otherwise("REMOTE")
    said = F.concat_ws(" ", F.col("title"), F.when(k % 5 == 0, "Reposted"), age, F.concat(F.lit("Over "), F.format_number(k % 900 + 1000, 0), F.lit(" people clicked apply")), word)
    parts = base_postings(spark, d).select(
        "job_id", "seq", "title", "company", F.when(k % 4 == 0, F.concat_ws(" · ", "company", F.lit("Remote, Earth"))).otherwise(F.col("company")).alias("meta_line"),
        F.when(k % 4 == 0, F.col("title")).otherwise(said).alias("top_text"))
    return P.build_postings(spread(parts)).select("job_id", "posted_days_ago", "applicants", "workplace_type", "reposted")


@query("cards_by_shape", over_postings("""SELECT CAST(floor(seq / 10) AS BIGINT) AS page_id, CAST(unnest(range(count(*))) AS INTEGER) AS card_no, count(*) AS members
 FROM postings GROUP BY 1 HAVING count(*) >= 3"""))
def _(spark, d):
    # A list without a single id: cards are the members of its largest group of like siblings. People's pages are no job lists.
    p = base_postings(spark, d).withColumn("page_id", F.floor(F.col("seq") / 10).cast("bigint"))
    card = page_of('<div class="c"><p>{title} at {company}, a place of work in a city</p><b>new</b></div>')
    other = page_of('<li><p>Somebody who works at {company} and lives nearby</p><a href="/in/p{seq}">me</a></li>')
    lists = p.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("cards"), F.array_join(F.array_sort(F.collect_list(other)), "").alias("people"))
    pages = lists.select("page_id", F.lit("https://board.example.com/jobs/").alias("url"), page_of("<main><section>{cards}</section><ul>{people}</ul></main>").alias("html"))
    found = B.cards(B.html_blocks(spread(pages)))
    return found.select("page_id", "card_no", F.count(F.lit(1)).over(Window.partitionBy("page_id")).alias("members"))


@query("keyed_cards", over_postings("""SELECT CAST(floor(seq / 10) AS BIGINT) AS page_id, job_id, CAST(row_number() OVER (PARTITION BY floor(seq / 10) ORDER BY seq) - 1 AS INTEGER) AS card_no FROM postings"""))
def _(spark, d):
    # Cards that carry the id in a component key, each twice, between keyed elements that are no buttons.
    p = base_postings(spark, d).withColumn("page_id", F.floor(F.col("seq") / 10).cast("bigint"))
    card = page_of('<div role="button" componentkey="job-card-component-ref-{job_id}"><p>{title}</p></div><div componentkey="job-card-component-ref-7{job_id}"></div>')
    lists = p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", card.alias("card")))).alias("cards"))
    both = F.array_join(F.concat(F.transform("cards", lambda c: c["card"]), F.transform("cards", lambda c: c["card"])), "")
    pages = lists.select("page_id", F.lit("https://board.example.com/jobs/search-results/").alias("url"), F.concat(F.lit("<main>"), both, F.lit("</main>")).alias("html"))
    return B.keyed_cards(B.html_blocks(spread(pages))).select("page_id", "job_id", "card_no")


@query("changed_blocks", over_postings("SELECT DISTINCT CAST(floor(seq / 10) AS BIGINT) AS page_id, 1 AS n_leaves FROM postings"))
def _(spark, d):
    moved = B.changed_blocks(parsed_board(spark, d), parsed_board(spark, d, "patient"), key="page_id")
    return moved.select("page_id", "n_leaves")


@query("moved_blocks", over_postings("SELECT DISTINCT CAST(floor(seq / 10) AS BIGINT) AS page_id, 'article' AS tag, TRUE AS deeper FROM postings"))
def _(spark, d):
    # The later snapshot has the description's section in an article and another word among the pills.
    pages = board_pages(spark, d)
    later = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<section>(?s:(.*?))</section>", "<article><section>$1</section></article>"), "Full-time", "Part-time"))
    moved = B.moved_blocks(parsed_board(spark, d), B.html_blocks(spread(later)), key="page_id")
    return moved.select("page_id", "tag", (~F.col("from_path").contains("article") & F.col("css_path").contains("article")).alias("deeper"))


@query("rule_audit", over_postings(f"""SELECT CAST(floor(seq / 10) AS BIGINT) AS page_id, rule, CASE rule WHEN 'applyButton' THEN FALSE WHEN 'card' THEN
 count(*) >= 3 WHEN 'list' THEN count(*) >= 3 ELSE TRUE END AS ok FROM postings, (SELECT unnest(['list', 'card', 'title', 'description', 'applyButton']) AS rule) GROUP BY 1, 2"""))
def _(spark, d):
    rules = {"list": {"tag": "ul"}, "card": {"attr": "data-job-id"}, "title": {"tag": "h1"}, "description": {"tag": "div", "cls": "body"},
             "applyButton": {"tag": "h2"}}
    return OL.rule_audit(parsed_board(spark, d), rules).select("page_id", "rule", "ok")


# ---- replies and claims ----

@query("field_gaps", over_postings("""SELECT job_id, concat_ws(',', CASE WHEN coalesce(workplace_type, 'Unknown') = 'Unknown' THEN 'workplaceType' END,
 'employmentType', 'seniority', CASE WHEN pay_min_annual IS NULL THEN 'payText' END, CASE WHEN coalesce(apply_type, 'unknown') = 'unknown' THEN 'applyRoute' END) AS gaps FROM postings"""))
def _(spark, d):
    return C.field_gaps(postings(spark, d)).select("job_id", F.array_join("gaps", ",").alias("gaps"))


@query("prompt_samples", """SELECT doc_id, trim(lang || chr(10) || chr(10) || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 4000 - length(lang) - 2)) AS sample FROM documents""")
def _(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", C.prompt_sample("lang", "text").alias("sample"))


@query("build_messages", over_postings("""SELECT job_id, CAST(2 + CASE WHEN coalesce(workplace_type, 'Unknown') = 'Unknown' THEN 1 ELSE 0 END +
 CASE WHEN pay_min_annual IS NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(apply_type, 'unknown') = 'unknown' THEN 1 ELSE 0 END AS INTEGER) AS asked,
 'JOB PAGE TEXT' || chr(10) || chr(10) || trim(title || chr(10) || chr(10) || trim(coalesce(description, '')), ' ' || chr(10)) AS said FROM postings"""))
def _(spark, d):
    g = C.field_gaps(postings(spark, d)).withColumn("sample", C.prompt_sample("title", "description"))
    m = C.build_messages(g)
    content = lambda i: F.get("messages", F.lit(i))["content"]
    return m.select("job_id", (F.size(F.split(content(0), "\n")) - 1).alias("asked"), content(1).alias("said"))


def reply_rows(spark, d):
    """A reply per posting: three body shapes, some with reasoning, prose, wrappers or cut off."""
    p = base_postings(spark, d)
    k = F.col("seq")
    inner = F.to_json(F.struct(
        F.col("company").alias("company"), F.when(k % 2 == 0, F.col("location")).otherwise("Elsewhere").alias("location"),
        F.when(k % 3 == 0, "remote").otherwise("Nowhere").alias("workplaceType"), F.lit("n/a").alias("title"),
        (k % 7).alias("payText"), F.lit("x").alias("bogus")))
    said = (F.when(k % 8 == 0, F.concat(F.lit("<think>maybe {\"title\":\"no\"}</think>"), inner))
            .when(k % 8 == 1, F.concat(F.lit("Sure! ```json\n"), inner, F.lit("\n``` done }")))
            .when(k % 8 == 2, F.lit("I cannot help with that."))
            .when(k % 8 == 3, F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner))
    text = F.struct(said.alias("content"))
    as_string = F.to_json(F.struct(F.array(F.struct(text.alias("message"))).alias("choices")))
    as_parts = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(
        F.struct(F.substring(said, F.lit(1), F.lit(5)).alias("text")), F.struct(F.substring(said, F.lit(6), F.length(said)).alias("text"))
    ).alias("content")).alias("message"))).alias("choices")))
    as_old = F.to_json(F.struct(F.array(F.struct(said.alias("text"))).alias("choices")))
    return p.select("job_id", "seq", "title", "company", "location", "workplace_type", F.when(k % 3 == 0, as_string).when(k % 3 == 1, as_parts).otherwise(as_old).alias("body"))


@query("parse_fields", over_postings("""SELECT job_id, CASE WHEN seq % 8 IN (2, 3) THEN 'no JSON object in the reply' END AS error_why,
 CASE WHEN seq % 8 NOT IN (2, 3) THEN company END AS company, CASE WHEN seq % 8 NOT IN (2, 3) THEN CAST(seq % 7 AS VARCHAR) END AS pay_text FROM postings"""))
def _(spark, d):
    f = C.parse_fields(C.read_replies(spread(reply_rows(spark, d))))
    return f.select("job_id", "error_why", F.try_element_at("fields", F.lit("company")).alias("company"),
                    F.try_element_at("fields", F.lit("payText")).alias("pay_text"))


@query("verify_claims", over_postings("""SELECT job_id, CAST(CASE WHEN seq % 8 IN (2, 3) THEN 0 ELSE CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN seq % 3 = 0
 AND workplace_type = 'Remote' THEN 1 ELSE 0 END END AS INTEGER) AS accepted, CASE WHEN seq % 8 IN (2, 3) THEN NULL WHEN seq % 3 <> 0
 THEN 'not one of Remote/Hybrid/On-site' WHEN workplace_type = 'Remote' THEN NULL ELSE 'the page does not say it' END AS workplace_why FROM postings"""))
def _(spark, d):
    # Unreadable replies stay in (they claim nothing): a filter on parsed columns would parse twice.
    f = C.parse_fields(C.read_replies(spread(reply_rows(spark, d))))
    page = F.concat_ws("  ", "company", F.upper("location"), F.when(F.col("workplace_type") == "Remote", F.col("workplace_type")))
    f = f.withColumn("sample", page).withColumn("current", F.create_map(F.lit("payText"), F.lit("$1")))
    v = C.verify_claims(f)
    why = F.get(F.filter("rejected", lambda r: r["field"] == "workplaceType"), F.lit(0))["why"]
    return v.select("job_id", F.size("accepted").alias("accepted"), why.alias("workplace_why"))


@query("verify_verbatim", """WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents),
 b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS v FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(t, v)""")
def _(spark, d):
    items = table(spark, d, "benchmark").select("item_id", squash_lower("text").alias("v"))
    docs = spread(table(spark, d, "documents")).select("doc_id", squash_lower("text").alias("page"))
    return VB.find_verbatim(docs, items, "doc_id", "page", "item_id", "v")


@query("apply_claims", over_postings("""SELECT job_id, CASE WHEN seq % 8 NOT IN (2, 3) AND seq % 2 = 0 THEN location ELSE 'gap' END AS location,
 CAST(CASE WHEN seq % 8 IN (2, 3) THEN 0 WHEN seq % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS filled FROM postings"""))
def _(spark, d):
    # Unreadable replies stay in (they claim nothing): a filter on parsed columns would parse twice.
    f = C.parse_fields(C.read_replies(spread(reply_rows(spark, d))))
    f = f.withColumn("sample", F.concat_ws(" ", "company", "location")).withColumn("current", F.create_map(F.lit("payText"), F.lit("$1"), F.lit("workplaceType"), F.lit("x")))
    acc = C.verify_claims(f).select("job_id", F.lit("m1").alias("model"), "accepted")
    gap = postings(spark, d).withColumn("location", F.lit("gap"))
    return C.apply_claims(gap, acc).select("job_id", "location", F.greatest(F.size("ai_fields"), F.lit(0)).alias("filled"))


@query("parse_plan", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.' || p_type WHEN 1 THEN 'a, b' WHEN 2 THEN NULL END AS card,
 CASE WHEN p_partkey % 4 = 2 THEN 'the reply named no usable selector' WHEN p_partkey % 4 = 3 THEN 'no JSON object in the reply' END AS error_why FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    text = (F.when(k % 4 == 0, F.concat(F.lit('{"selectors":{"card":".'), "p_type", F.lit('","list":"body"},"notes":"fine"}')))
            .when(k % 4 == 1, F.lit('{"plan":{"card":["a"," ","b"]}}')).when(k % 4 == 2, F.lit('{"card":"none","list":"*"}')).otherwise("no idea"))
    return C.parse_plan(table(spark, d, "part").select("p_partkey", text.alias("text"))).select(
        "p_partkey", F.try_element_at("plan", F.lit("card")).alias("card"), "error_why")


def model_replies(spark, d):
    """Line items as model replies to their order's request: the line number is the model's rank."""
    li = table(spark, d, "lineitem")
    m = F.col("l_partkey") % 10
    return li.select(F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_linenumber").alias("model_rank"),
                     F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
                     F.when(m < 4, 429).when(m == 4, 401).when(m == 5, 404).otherwise(200).alias("status"), F.lit(None).cast("string").alias("error"),
                     F.lit("t").alias("text"), (m >= 7).alias("usable"))


@query("first_usable_reply", """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 >= 7 THEN 'ok' WHEN l_partkey % 10 = 4 THEN 'auth' ELSE 'bad' END AS s,
 CASE WHEN l_partkey % 10 < 4 THEN 'rate limited (429)' WHEN l_partkey % 10 = 4 THEN 'the API key was rejected (401)' WHEN l_partkey % 10 = 5 THEN 'no such model (404)'
 WHEN l_partkey % 10 = 6 THEN 'the reply could not be used' ELSE '' END AS w, l_partkey FROM lineitem),
 one AS (SELECT l_orderkey, l_linenumber, arg_min(s, w) AS s FROM r GROUP BY ALL),
 a AS (SELECT l_orderkey, min(CASE WHEN s = 'auth' THEN l_linenumber END) AS stop, min(CASE WHEN s = 'ok' THEN l_linenumber END) AS ok FROM one GROUP BY l_orderkey)
 SELECT CAST(l_orderkey AS VARCHAR) AS request_id, ok IS NOT NULL AND (stop IS NULL OR ok < stop) AS ok,
 CASE WHEN ok IS NOT NULL AND (stop IS NULL OR ok < stop) THEN 'm' || ok END AS model FROM a""")
def _(spark, d):
    return C.first_usable_reply(model_replies(spark, d)).select("request_id", "ok", "model")


@query("call_budget", """WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 t AS (SELECT *, min(CASE WHEN event_type = 'error' THEN n END) OVER (PARTITION BY user_id) AS hit FROM a WHERE n <= 30)
 SELECT user_id AS run_id, event_id AS seq, CAST(n AS INTEGER) AS call_no FROM t WHERE hit IS NULL OR n <= hit""")
def _(spark, d):
    asks = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("rate_limited"))
    return C.call_budget(asks).select("run_id", "seq", "call_no")


@query("latest_plans", "SELECT '/p/' || user_id AS path, 'm' || (max(event_id) % 5) AS model FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events")
    plans = e.select(F.concat(F.lit("/p/"), F.col("user_id").cast("string")).alias("path"), F.create_map(F.lit("card"), F.lit("li")).alias("plan"),
                     F.lit("").alias("notes"), F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("model"),
                     F.timestamp_seconds(F.col("event_id")).alias("at"))
    return C.latest_plan(plans).select("path", "model")


# ---- streaming ----

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("stream_intake", "SELECT 'u' || user_id AS job_id, min(event_id) AS seq FROM events GROUP BY user_id")
def _(spark, d):
    rows = I.read_arrivals(spark, f"{d}/events*.parquet", EVENTS).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"), F.lit("stream").alias("source"))
    store = scratch(spark, "store")
    I.stream_intake(rows, store, scratch(spark, "intake"), once=True).awaitTermination()
    return M.read_postings(spark, store).select("job_id", "seq")


@query("stream_counters", "SELECT 'run' || (user_id % 10) AS run_id, event_type AS outcome, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    rows = I.read_arrivals(spark, f"{d}/events*.parquet", EVENTS).select(
        F.concat(F.lit("run"), (F.col("user_id") % 10).cast("string")).alias("run_id"), F.col("event_type").alias("outcome"))
    out = scratch(spark, "counters")
    I.stream_counters(rows, out, scratch(spark, "counting"), once=True).awaitTermination()
    return I.read_counters(spark, out)


@query("stream_verdicts", f"""SELECT {_IDENT} AS job_id, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS verdict, 'toxic ' || toxic AS reason FROM labels""")
def _(spark, d):
    rows = I.read_arrivals(spark, f"{d}/labels*.parquet", "doc_id bigint, quality int, toxic int")
    turns = rows.select(
        F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"),
        F.concat(F.lit("VERDICT job"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.when(F.col("quality") == 1, " ACCEPT").otherwise(" REJECT"),
                 F.lit(": toxic "), F.col("toxic").cast("string")).alias("text"))
    memory = scratch(spark, "verdicts")
    I.stream_verdicts(turns, memory, scratch(spark, "verdict-reading"), once=True).awaitTermination()
    return M.read_memory(spark, memory, VERDICTS, "job_id", "at").select("job_id", "verdict", "reason")


# ---- rows that break, repeat or tie ----

@query("refused_hits", """SELECT c_custkey AS k, CAST(CASE c_custkey % 4 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS INTEGER) AS n_hits,
 CASE WHEN c_custkey % 4 < 2 THEN CAST(2 - c_custkey % 4 AS VARCHAR) || ' hit(s) could not be read' END AS error, c_custkey % 4 = 3 AS last_page FROM customer""")
def _(spark, d):
    k = F.col("c_custkey")
    hits = (F.when(k % 4 == 0, F.concat(F.lit('[7,{"id":"a'), k.cast("string"), F.lit('"},null,"x"]')))
            .when(k % 4 == 1, '[{"id":"b"},[1]]').when(k % 4 == 2, '[{"id":"c","is_expired":"no"},{"id":5,"job_information":[]}]').otherwise("[]"))
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"ssrHits":'), hits, F.lit("}}}</script>"))
    pages = table(spark, d, "customer").select(k.alias("k"), html.alias("html"))
    return N.read_search_pages(pages).select("k", F.size("hits").alias("n_hits"), "error", "last_page")


@query("fractional_years", """SELECT CAST(s_suppkey AS VARCHAR) AS job_id, CAST(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE ceil(s_suppkey % 9 / 2.0) END AS INTEGER) AS yoe_min
 FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    hit = F.concat(F.lit('{"id":"'), k.cast("string"), F.lit('","v5_processed_job_data":{"is_min_industry_and_role_yoe_not_mentioned":'),
                   F.when(k % 3 == 0, "true").otherwise("false"), F.lit(',"min_industry_and_role_yoe":'), (k % 9 / 2).cast("string"), F.lit("}}"))
    hits = table(spark, d, "supplier").select(F.from_json(hit, N.HIT).alias("hit"))
    return N.normalise_hit(hits, now_ms=0).select("job_id", "yoe_min")


@query("tag_rows_repeated", over_postings("""SELECT job_id, seq % 2 = 0 AS seen, CASE WHEN seq % 3 = 0 THEN 'reject' END AS verdict,
 CASE WHEN seq % 3 = 0 THEN 'newer' END AS reason FROM postings"""))
def _(spark, d):
    p = postings(spark, d)
    even, third = p.where("seq % 2 = 0").select("job_id"), p.where("seq % 3 = 0").select("job_id")
    history = even.select("job_id", F.timestamp_seconds(F.lit(1)).alias("exported_at")).union(even.select("job_id", F.timestamp_seconds(F.lit(2))))
    said = lambda v, why, t: third.select("job_id", F.lit(v).alias("verdict"), F.lit(why).alias("reason"), F.timestamp_seconds(F.lit(t)).alias("at"))
    return L.tag_rows(p, history, said("accept", "older", 1).union(said("reject", "newer", 2))).select("job_id", "seen", "verdict", "reason")


@query("apply_claims_repeated", over_postings("SELECT job_id, 'by m1' AS location, 'm1' AS who FROM postings"))
def _(spark, d):
    p = postings(spark, d).withColumn("location", F.lit(None).cast("string"))
    said = lambda m, rank: p.select("job_id", F.lit(m).alias("model"), F.lit(rank).alias("model_rank"),
                                    F.create_map(F.lit("location"), F.lit(f"by {m}")).alias("accepted"))
    return C.apply_claims(p, said("m0", 2).union(said("m1", 1))).select("job_id", "location", F.try_element_at("ai_fields", F.lit("location")).alias("who"))


@query("criteria_country", """SELECT CAST(c_custkey AS VARCHAR) AS job_id FROM customer WHERE c_custkey % 5 NOT IN (1, 3)""")
def _(spark, d):
    k = F.col("c_custkey")
    place = F.when(k % 5 == 0, "Boston, United States").when(k % 5 == 1, "Leeds, UK").when(k % 5 == 2, "somewhere").when(k % 5 == 3, "Paris, FR").otherwise(None)
    rows = table(spark, d, "customer").select(k.cast("string").alias("job_id"), place.alias("location"))
    return N.criteria_filter(rows, {"country": "US"}).select("job_id")


@query("pane_changed", """SELECT CAST(s_suppkey AS VARCHAR) AS job_id FROM supplier WHERE s_suppkey % 3 <> 1""")
def _(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    listing = s.select(k.cast("string").alias("job_id"), F.lit("Harbour pilot").alias("title"))
    detail = s.select(k.cast("string").alias("job_id"), F.when(k % 3 == 0, "Harbour Pilot (m/f)").otherwise("Loading").alias("title"),
                      F.repeat(F.lit("words "), 40).alias("description"), F.lit("s1").alias("before"),
                      F.when(k % 3 == 2, "s2").otherwise("s1").alias("signature"))
    return P.detail_matches_listing(detail, listing).select("job_id")


@query("long_link_texts", """SELECT CAST(s_suppkey AS INTEGER) AS page_id, CAST(50 + s_suppkey AS VARCHAR) AS job_id, CAST(length('Pilot ' || repeat('very ', 90) || 'long') AS INTEGER) AS text_chars
 FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey").cast("int")
    html = F.concat(F.lit('<main><div><a href="/jobs/view/'), (k + 50).cast("string"), F.lit('/">Pilot '), F.repeat(F.lit("very "), 90), F.lit("<b>long</b></a></div></main>"))
    pages = table(spark, d, "supplier").select(k.alias("page_id"), F.lit("https://b.example.com/jobs").alias("url"), html.alias("html"))
    return B.job_links(B.html_blocks(pages)).select("page_id", "job_id", F.length("text").alias("text_chars"))


# ---- files that sinks write, and streams with a restart ----

_CSV_ROW = "job_id || ',' || title || ',' || company || repeat(',', %d)" % (len(SK.CSV_COLUMNS) - 3)


@query("csv_file", over_postings(f"SELECT 'header' AS kind, '{','.join(SK.CSV_COLUMNS.values())}' AS line UNION ALL SELECT 'row', {_CSV_ROW} FROM postings"))
def _(spark, d):
    path = scratch(spark, "csv")
    SK.write_csv(postings(spark, d).select("job_id", "title", "company", "seq"), path)
    lines = spark.read.option("lineSep", "\r\n").text(path)
    line = F.regexp_replace("value", f"^{SK.BOM}", "")  # the reader may have taken the mark for its own
    return lines.select(F.when(F.startswith(line, F.lit("jobId,")), "header").otherwise("row").alias("kind"), line.alias("line"))


@query("json_file", over_postings("SELECT job_id, title, seq FROM postings"))
def _(spark, d):
    path = scratch(spark, "json")
    SK.write_json(postings(spark, d).select("job_id", "title", "seq"), path)
    return spark.read.schema("job_id string, title string, seq bigint").json(path)


@query("batch_files", "SELECT 'batch ' || p_partkey || ' ' || p_name AS text FROM part")
def _(spark, d):
    path = scratch(spark, "batches")
    k = F.col("p_partkey")
    SK.write_batches(table(spark, d, "part").select(k.alias("batch_no"), F.concat(F.lit("batch "), k.cast("string"), F.lit(" "), "p_name").alias("text")), path)
    return spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("text"))


@query("stream_restart", """SELECT 'u' || user_id AS job_id, coalesce(min(CASE WHEN event_id % 2 = 0 THEN event_id END), min(event_id)) AS seq FROM events GROUP BY user_id""")
def _(spark, d):
    # Even events arrive in several files and micro-batches, then the stream stops; odd ones find it restarted.
    events, landing, store, checkpoint = table(spark, d, "events"), scratch(spark, "landing"), scratch(spark, "store"), scratch(spark, "intake")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).repartition(3, "user_id").write.mode("append").parquet(landing)
        rows = I.read_arrivals(spark, landing, EVENTS, files_per_batch=1).select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"), F.lit("stream").alias("source"))
        I.stream_intake(rows, store, checkpoint, once=True).awaitTermination()
    return M.read_postings(spark, store).select("job_id", "seq")


def event_postings(events):
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"), F.lit("stream").alias("source"))


FIRST_EVENTS = "SELECT 'u' || user_id AS job_id, min(event_id) AS seq FROM events GROUP BY user_id"


@query("stream_batches", FIRST_EVENTS)
def _(spark, d):
    # The events arrive in four parts, in order; the stream stops after each and starts again. Together they must be one dedupe over all.
    events, landing, store, checkpoint = table(spark, d, "events"), scratch(spark, "landing"), scratch(spark, "store"), scratch(spark, "intake")
    top = events.agg(F.max("event_id")).first()[0] or 0
    for part in range(4):
        events.where(F.least(F.floor(F.col("event_id") * 4 / (top + 1)), F.lit(3)) == part).write.mode("append").parquet(landing)
        I.stream_intake(event_postings(I.read_arrivals(spark, landing, EVENTS)), store, checkpoint, once=True).awaitTermination()
    return M.read_postings(spark, store).select("job_id", "seq")


@query("append_batches", "SELECT 'u' || user_id AS job_id, coalesce(min(CASE WHEN event_id % 3 = 0 THEN event_id END), min(event_id)) AS seq FROM events GROUP BY user_id")
def _(spark, d):
    # Every third event first, then all of them, twice: what is stored stays.
    rows, store = event_postings(table(spark, d, "events")), scratch(spark, "store")
    for batch in (rows.where("seq % 3 = 0"), rows, rows):
        M.append_postings(spark, batch, store)
    return M.read_postings(spark, store).select("job_id", "seq")


@query("stream_counters_again", "SELECT 'run' || (user_id % 10) AS run_id, event_type AS outcome, 2 * count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    out = scratch(spark, "counters")
    for _i in range(2):  # a second stream with a checkpoint of its own adds to the table
        rows = I.read_arrivals(spark, f"{d}/events*.parquet", EVENTS).select(
            F.concat(F.lit("run"), (F.col("user_id") % 10).cast("string")).alias("run_id"), F.col("event_type").alias("outcome"))
        I.stream_counters(rows, out, scratch(spark, "counting"), once=True).awaitTermination()
    return I.read_counters(spark, out)
