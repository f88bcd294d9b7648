"""Inputs for the registered queries, derived by Spark from the driver's tables.

Each view has a SQL twin (``SQL``) that builds the same rows, so a query can be checked against plain SQL
over the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.schema import as_postings

CHARS_PAD = (
    "The team builds tools that people rely on every day and values careful work, clear writing and steady "
    "progress over loud promises. You will join a small group and help it grow. "
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the tables are fewer files than cores, as test tables are. Only file names are looked at: no job
    runs, and tables of many files are left as they lie. Rows are the same either way."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if len(df.inputFiles()) < want else df


def _pick(k: Column, *options: str | None) -> Column:
    out = None
    for i, o in enumerate(options):
        cond = k % len(options) == i
        out = F.when(cond, F.lit(o)) if out is None else out.when(cond, F.lit(o))
    return out


def money(n: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(n, 0))


def base_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per order, with every kind of gap a filter has to survive."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    k = F.col("o_orderkey")
    lo = F.floor("o_totalprice").cast("bigint")
    rows = j.select(
        k.cast("string").alias("job_id"), k.alias("seq"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.col("c_name").alias("company"), F.col("n_name").alias("location"),
        F.concat(F.lit("https://example.com/company/"), F.col("o_custkey").cast("string")).alias("company_url"),
        _pick(k, "Remote", "Hybrid", "On-site", "Unknown", None).alias("workplace_type"),
        _pick(k, "external", "easy_apply", "closed", "applied", "unknown", None, "external").alias("apply_type"),
        F.when(k % 11 != 1, k % 11 == 0).alias("reposted"), (k % 13 == 0).alias("promoted"),
        F.when(~(k % 17).isin(1, 2), k % 17 == 0).alias("needs_clearance"),
        F.when(k % 19 != 1, k % 19 == 0).alias("sponsorship_unavailable"),
        F.when(k % 23 != 1, k % 23 == 0).alias("requires_relocation"),
        ((k % 5 == 0) & (k % 3 == 0)).alias("remote_contradiction"),
        F.when(k % 9 != 0, k % 500).cast("int").alias("applicants"),
        F.when(k % 8 != 0, F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date")))
        .alias("posted_days_ago"),
        F.when(k % 6 != 0, lo).alias("pay_min_annual"),
        F.when((k % 6 != 0) & (k % 4 != 0), lo + F.floor(lo / 4)).alias("pay_max_annual"),
        F.when(k % 10 != 0, k % 26).cast("int").alias("yoe_min"),
        F.when(k % 12 != 0, (k % 21) * 5).cast("int").alias("travel_pct"),
        F.when(k % 7 == 0, F.concat(F.lit("https://jobs.example.com/a/"), k.cast("string"))).alias("apply_url"),
        F.concat(F.lit("https://jobs.example.com/view/"), k.cast("string")).alias("url"),
        F.when(k % 14 != 0, F.concat(
            F.lit(CHARS_PAD), F.lit("Reference "), F.col("o_orderstatus"), F.lit("-"), (k % 97).cast("string"),
            F.when(k % 3 == 0, F.lit(" Python required.")).otherwise(F.lit(" SQL required.")))).alias("description"),
        F.lit("board").alias("source"),
    )
    return rows.withColumn("description_chars", F.length("description"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_postings(base_postings(spark, sf_dir))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting text per order whose facts are known from its columns."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    lo = F.floor("o_totalprice").cast("bigint")
    hi = lo + F.floor(lo / 4)
    pay = (
        F.when(k % 5 == 0, F.concat(F.lit("Salary "), money(lo), F.lit(" - "), money(hi), F.lit(" per year. ")))
        .when(k % 5 == 1, F.concat(F.lit("Pay range: $"), F.floor(lo / 1000).cast("string"), F.lit("K to $"),
                                   F.floor(hi / 1000).cast("string"), F.lit("K. ")))
        .when(k % 5 == 2, F.concat(F.lit("Compensation is USD "), F.format_number(lo, 0), F.lit(" annually. ")))
        .when(k % 5 == 3, F.concat(F.lit("Hourly rate: $"), (k % 100 + 5).cast("string"), F.lit("/hr. ")))
        .otherwise(F.concat(F.lit("The fund raised $"), (k % 90 + 10).cast("string"), F.lit(" million in funding. ")))
    )
    years = (
        F.when(k % 4 == 0, F.lit("Trusted by partners, in business for over 20 years. "))
        .when(k % 4 == 1, F.concat((k % 30).cast("string"), F.lit("+ years of experience required. ")))
        .when(k % 4 == 2, F.concat((k % 9 + 1).cast("string"), F.lit("-"), (k % 9 + 3).cast("string"),
                                   F.lit(" years of relevant experience. ")))
        .otherwise(F.lit("Minimum of seven (7) years experience. "))
    )
    travel = F.when(k % 3 == 0, F.concat(F.lit("Travel up to "), (k % 130).cast("string"), F.lit("% is expected. "))).otherwise("")
    office = F.when(k % 7 == 0, F.concat(F.lit("On-site "), (k % 6 + 1).cast("string"), F.lit(" days per week. "))).otherwise("")
    flags = F.concat(
        F.when(k % 11 == 0, F.lit("An active security clearance is needed. ")).otherwise(""),
        F.when(k % 13 == 0, F.lit("We cannot sponsor visas. ")).otherwise(""),
        F.when(k % 17 == 0, F.lit("You must relocate. ")).otherwise(""),
        F.when(k % 19 == 0, F.lit("This is not a remote role. ")).otherwise(""))
    text = F.concat(pay, F.lit(CHARS_PAD), years, F.lit(CHARS_PAD), travel, office, flags)
    return o.select(k.cast("string").alias("job_id"), k.alias("seq"), text.alias("description"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real chat turns, plus one verdict turn per labelled document in four line shapes."""
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lab = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    verb = F.when(F.col("quality") == 1, "ACCEPT").otherwise("REJECT")
    low = F.when(F.col("quality") == 1, "accept").otherwise("reject")
    ident = F.concat(F.lit("job"), F.lpad(d.cast("string"), 7, "0"))
    line = (
        F.when(d % 4 == 0, F.concat(F.lit("VERDICT "), ident, F.lit(" "), verb, F.lit(": reason "), F.col("toxic").cast("string")))
        .when(d % 4 == 1, F.concat(ident, F.lit(" - "), low, F.lit(", because")))
        .when(d % 4 == 2, F.concat(low, F.lit(" "), ident, F.lit(": short")))
        .otherwise(F.concat(F.lit("VERDICT "), ident, F.lit(" "), ident, F.lit(" "), verb))
    )
    again = F.when(d % 12 == 0, F.concat(F.lit("\nActually:\nVERDICT "), ident, F.lit(" REJECT: changed"))).otherwise("")
    made = lab.select((d % 97 + 1_000_000).alias("conv_id"), d.alias("turn"),
                      F.concat(F.lit("My read:\n"), line, again, F.lit("\n\nThat is all.")).alias("text"))
    return real.unionByName(made)


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search result pages of up to ten suppliers' parts each, some of them broken."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    yearly, hourly = k % 4 == 0, k % 4 == 1
    data = F.struct(
        F.when(k % 5 != 0, F.col("p_brand")).alias("company_name"), F.col("p_name").alias("core_job_title"),
        F.concat(F.lit("Town "), (k % 50).cast("string")).alias("formatted_workplace_location"),
        _pick(k, "Onsite", "Hybrid", "Remote", "Field", None).alias("workplace_type"),
        F.when(k % 7 != 0, F.concat(F.lit("Summary of "), F.col("p_type"))).alias("requirements_summary"),
        F.when(k % 9 == 0, "EUR").when(k % 9 == 1, "USD").alias("listed_compensation_currency"),
        F.when(yearly, F.col("p_retailprice") * 100).alias("yearly_min_compensation"),
        F.when(yearly & (k % 3 != 0), F.col("p_retailprice") * 100 + F.col("p_size")).alias("yearly_max_compensation"),
        F.when(hourly, F.col("p_size") + 10).cast("double").alias("hourly_min_compensation"),
        F.when(k % 6 != 0, F.col("p_size") % 20).cast("double").alias("min_industry_and_role_yoe"),
        F.when(k % 3 == 0, F.lit(False)).when(k % 3 == 1, F.lit(True)).alias("is_min_industry_and_role_yoe_not_mentioned"),
        _pick(k, "None", "Extensive travel", "Occasional", None, "").alias("air_travel_requirement"),
        _pick(F.floor(k / 2), "None", None, "Moderate", "varies").alias("land_travel_requirement"),
        _pick(k, None, "None", "Secret", "").alias("security_clearance"),
        F.when(k % 3 != 0, k % 3 == 1).alias("visa_sponsorship"),
        F.when(k % 4 != 0, F.array(F.col("p_type"), F.lit(" "))).alias("technical_tools"),
        F.when(k % 5 != 0, F.lit("Mid")).alias("seniority_level"),
        (F.lit(1_000_000_000_000) + k * 3_600_000).alias("estimated_publish_date_millis"),
    )
    hit = F.struct(
        F.when(k % 10 != 3, F.concat(F.lit("hit"), k.cast("string"))).alias("id"),
        F.when(k % 20 != 13, F.concat(F.lit("obj"), k.cast("string"))).alias("objectID"),
        F.when(k % 3 != 0, F.concat(F.lit("https://ats.example.com/"), k.cast("string"))).alias("apply_url"),
        F.col("p_brand").alias("source"), (k % 25 == 7).alias("is_expired"),
        F.when(k % 8 == 0, F.struct(F.concat(F.lit("Head of "), F.col("p_name")).alias("title"))).alias("job_information"),
        F.struct(F.concat(F.lit("Co "), F.col("p_brand")).alias("name")).alias("enriched_company_data"),
        data.alias("v5_processed_job_data"))
    # Ten consecutive keys to a page, so a page's list is small by construction.
    pages = p.select(F.floor(k / 10).cast("bigint").alias("page_no"), k.alias("k"), hit.alias("hit")).groupBy(
        "page_no").agg(F.sort_array(F.collect_list(F.struct("k", F.to_json("hit").alias("j")))).alias("h"))
    n = F.col("page_no")
    props = F.concat(
        F.lit('{"props":{"pageProps":{"ssrPage":'), n.cast("string"), F.lit(',"ssrTotalCount":'),
        (n * 7).cast("string"), F.lit(',"ssrIsLastPage":'), F.when(n % 5 == 0, "true").otherwise("false"),
        F.lit(',"ssrHits":['), F.array_join(F.transform("h", lambda x: x["j"]), ","), F.lit("]}}}"))
    body = F.when(n % 11 == 4, F.lit("{broken")).otherwise(props)
    html = F.when(n % 13 == 5, F.lit("<html><body>try later</body></html>")).otherwise(F.concat(
        F.lit('<html><head></head><body><div>x</div><script id="__NEXT_DATA__" type="application/json">'), body,
        F.lit("</script></body></html>")))
    return pages.select("page_no", html.alias("html"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail bodies for two thirds of the hits, plus junk."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    inner = F.struct(F.struct(F.struct(F.concat(
        F.lit("<p>Full text of "), F.col("p_name"), F.lit(" &amp; more</p><ul><li>one</li><li>two</li></ul>")
    ).alias("description")).alias("job_information")).alias("job"))
    return p.where(k % 3 != 1).select(
        F.concat(F.lit("hit"), k.cast("string")).alias("job_id"),
        F.when(k % 7 == 2, F.lit("not json")).otherwise(F.to_json(inner)).alias("body"))


def board_pages(spark: SparkSession, sf_dir: str, marker: str = "reliable") -> DataFrame:
    """A two-pane board page per ten orders: the list of all ten and the first one's details."""
    p = base_postings(spark, sf_dir)
    k = F.col("seq")
    card = F.concat(
        F.lit('<li data-job-id="'), "job_id", F.lit('"><a href="/jobs/view/'), "job_id", F.lit('/">'), "title",
        F.lit("</a><span>"), "company", F.lit(" located in "), "location", F.lit("</span></li>"))
    grouped = p.withColumn("page_id", F.floor(k / 10).cast("bigint")).groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct(k.alias("k"), card.alias("card")))).alias("cards"),
        F.min_by(F.struct("title", "company", "location", "posted_days_ago", "applicants", "workplace_type",
                          "apply_type", "job_id", "pay_min_annual"), k).alias("s"))
    s = lambda c: F.col(f"s.{c}")
    meta = F.concat_ws(
        " · ", s("location"), F.concat(F.coalesce(s("posted_days_ago"), F.lit(1)).cast("string"), F.lit(" days ago")),
        F.concat(F.coalesce(s("applicants"), F.lit(3)).cast("string"), F.lit(" applicants")))
    apply = F.when(s("apply_type") == "easy_apply", F.lit('<button aria-label="Easy Apply to this job">Easy Apply</button>')).when(
        s("apply_type") == "external", F.lit('<a href="https://ats.example.com/apply">Apply</a>')).otherwise("")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Jobs</title><style>p{margin:0}</style></head><body><nav><h2>0 notifications"
              '</h2><a href="/company/none">None</a></nav><main><div class="rail"><ul>'),
        F.array_join(F.transform("cards", lambda c: c["card"]), ""),
        F.lit('</ul></div><div class="pane"><div class="top"><h1>'), s("title"),
        F.lit('</h1><a href="/company/c'), F.col("page_id").cast("string"), F.lit('">'), s("company"),
        F.lit(' 1,234 followers</a><div class="meta">'), meta, F.lit('</div><span class="pill">'),
        F.coalesce(s("workplace_type"), F.lit("Unknown")), F.lit('</span><span class="pill">Full-time</span>'), apply,
        F.lit('</div><section><h2>About the job</h2><div class="body"><p>'), F.lit(CHARS_PAD.strip() + f" We want {marker} people."),
        F.lit("</p><ul><li>Salary "), money(F.coalesce(s("pay_min_annual"), F.lit(50_000)) + 10_000),
        F.lit(" per year</li><li>3+ years of experience</li></ul></div></section></div></main></body></html>"))
    return grouped.select("page_id", F.concat(F.lit("https://board.example.com/jobs/search?p="),
                                              F.col("page_id").cast("string")).alias("url"), html.alias("html"))


# ---- the same rows in SQL ----

def _case(k: str, *options: str | None) -> str:
    whens = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options) if o is not None)
    return f"CASE ({k}) % {len(options)} {whens} END"


_LO = "CAST(floor(o_totalprice) AS BIGINT)"
_HI = f"({_LO} + CAST(floor({_LO} / 4.0) AS BIGINT))"

SQL_POSTINGS = f"""postings AS (
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderkey AS seq, o_orderpriority || ' ' || c_mktsegment AS title,
 c_name AS company, n_name AS location, 'https://example.com/company/' || o_custkey AS company_url,
 {_case('o_orderkey', 'Remote', 'Hybrid', 'On-site', 'Unknown', None)} AS workplace_type,
 {_case('o_orderkey', 'external', 'easy_apply', 'closed', 'applied', 'unknown', None, 'external')} AS apply_type,
 CASE WHEN o_orderkey % 11 <> 1 THEN o_orderkey % 11 = 0 END AS reposted, o_orderkey % 13 = 0 AS promoted,
 CASE WHEN o_orderkey % 17 NOT IN (1, 2) THEN o_orderkey % 17 = 0 END AS needs_clearance,
 CASE WHEN o_orderkey % 19 <> 1 THEN o_orderkey % 19 = 0 END AS sponsorship_unavailable,
 CASE WHEN o_orderkey % 23 <> 1 THEN o_orderkey % 23 = 0 END AS requires_relocation,
 (o_orderkey % 5 = 0 AND o_orderkey % 3 = 0) AS remote_contradiction,
 CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 500 AS INTEGER) END AS applicants,
 CASE WHEN o_orderkey % 8 <> 0 THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS INTEGER) END
   AS posted_days_ago,
 CASE WHEN o_orderkey % 6 <> 0 THEN {_LO} END AS pay_min_annual,
 CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 4 <> 0 THEN {_HI} END AS pay_max_annual,
 CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey % 26 AS INTEGER) END AS yoe_min,
 CASE WHEN o_orderkey % 12 <> 0 THEN CAST((o_orderkey % 21) * 5 AS INTEGER) END AS travel_pct,
 CASE WHEN o_orderkey % 7 = 0 THEN 'https://jobs.example.com/a/' || o_orderkey END AS apply_url,
 'https://jobs.example.com/view/' || o_orderkey AS url,
 CASE WHEN o_orderkey % 14 <> 0 THEN '{CHARS_PAD}Reference ' || o_orderstatus || '-' || (o_orderkey % 97) ||
   CASE WHEN o_orderkey % 3 = 0 THEN ' Python required.' ELSE ' SQL required.' END END AS description
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
