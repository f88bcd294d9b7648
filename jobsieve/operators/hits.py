"""Search pages of nested hits to postings: structured normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.facts import PER_YEAR, extract_facts
from jobsieve.functions.htmltext import html_to_text
from jobsieve.functions.regex import rx
from jobsieve.functions.text import blank_to_null, col, grouped, js_round, or_empty, trim_all
from jobsieve.schema import as_postings

HIT = """struct<
  id: string, objectID: string, apply_url: string, source: string, board_token: string,
  strict_dedup_cluster_id: string, is_expired: boolean,
  job_information: struct<title: string>,
  enriched_company_data: struct<name: string, homepage_uri: string>,
  v5_processed_job_data: struct<
    core_job_title: string, company_name: string, company_website: string,
    formatted_workplace_location: string, workplace_type: string, seniority_level: string,
    commitment: array<string>, requirements_summary: string,
    listed_compensation_currency: string,
    yearly_min_compensation: double, yearly_max_compensation: double,
    hourly_min_compensation: double, hourly_max_compensation: double,
    min_industry_and_role_yoe: double, is_min_industry_and_role_yoe_not_mentioned: boolean,
    air_travel_requirement: string, land_travel_requirement: string,
    security_clearance: string, visa_sponsorship: boolean,
    licenses_or_certifications: array<string>, technical_tools: array<string>, role_activities: array<string>,
    estimated_publish_date: string, estimated_publish_date_millis: bigint>>"""

# ---- Fixed values: vocabulary of the structured source ----
SOURCE = "hiringcafe"
WORKPLACE = {"Onsite": "On-site", "Hybrid": "Hybrid", "Remote": "Remote"}
TRAVEL_OFTEN = rx("^(extensive|frequent|constant){B}", True)
TRAVEL_SOME = rx("^(occasional|some|moderate|limited){B}", True)
NONE = "(?i)^none$"
COUNTRIES = {
    "united states": "US", "usa": "US", "us": "US", "united kingdom": "GB", "uk": "GB", "canada": "CA",
    "australia": "AU", "germany": "DE", "france": "FR", "india": "IN", "ireland": "IE", "netherlands": "NL",
    "spain": "ES",
}
WORKPLACE_CODES = {"1": ["Onsite"], "2": ["Remote"], "3": ["Hybrid"], "2,3": ["Remote", "Hybrid"]}
NEXT_DATA = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'
DAY_MS = 86_400_000
# ---- end of fixed values ----


def read_search_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """HTML pages to envelopes: ``hits``, ``page``, ``total``, ``last_page``, ``error``.

    A broken page is zero hits and a reason, never a failure. A hit that is no object costs that hit only and is counted in
    ``error``; null hits are left out. Hits stay an array; see ``explode_hits``.
    """
    raw = blank_to_null(F.regexp_extract(or_empty(html), NEXT_DATA, 1))
    doc = pages.withColumn("_json", F.when(F.try_parse_json(raw).isNotNull(), raw))
    doc = doc.withColumn("_p", F.get_json_object("_json", "$.props.pageProps"))
    have = F.col("_p").isNotNull() & F.startswith(F.col("_p"), F.lit("{"))
    hits_json = F.get_json_object("_p", "$.ssrHits")
    none = F.array().cast("array<variant>")
    said = F.coalesce(F.when(have, F.try_variant_get(F.try_parse_json(hits_json), "$", "array<variant>")), none)
    is_object = lambda x: F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False))
    is_null = lambda x: F.isnull(x) | F.is_variant_null(x)
    meta = F.from_json("_p", "ssrPage bigint, ssrTotalCount bigint, ssrIsLastPage boolean, ssrError string")
    doc = doc.withColumn("_m", meta).withColumn("_said", said).withColumns({
        "hits": F.transform(F.filter("_said", is_object), lambda x: F.from_json(F.to_json(x), HIT)),
        "_refused": F.size(F.filter("_said", lambda x: ~is_object(x) & ~is_null(x))),
    })
    refused = F.when(F.col("_refused") > 0, F.concat(F.col("_refused").cast("string"), F.lit(" hit(s) could not be read")))
    keep = [c for c in pages.columns if c != html]
    return doc.select(
        *keep, "hits",
        F.coalesce("_m.ssrPage", F.lit(0)).alias("page"),
        F.col("_m.ssrTotalCount").alias("total"),
        (F.coalesce("_m.ssrIsLastPage", F.lit(False)) | (F.size("_said") == 0)).alias("last_page"),
        F.when(~F.coalesce(have, F.lit(False)), F.lit("no __NEXT_DATA__ pageProps")).otherwise(
            blank_to_null(F.concat_ws("; ", blank_to_null("_m.ssrError"), refused))).alias("error"),
    )


def explode_hits(envelopes: DataFrame) -> DataFrame:
    """One row per hit with its place on the page."""
    keep = [c for c in envelopes.columns if c not in ("hits", "error", "last_page", "total")]
    return envelopes.select(*keep, F.posexplode_outer("hits").alias("hit_no", "hit")).where("hit is not null")


def read_detail_json(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Detail responses to plain text; junk gives an empty string."""
    html = F.get_json_object(F.col(body), "$.job.job_information.description")
    return bodies.withColumn("_html", F.coalesce(html, F.lit(""))).select(
        *[c for c in bodies.columns if c != body], html_to_text("_html").alias("text"))


def hit_id(hit: Column) -> Column:
    return F.coalesce(blank_to_null(hit["id"]), blank_to_null(hit["objectID"]))


def clean_list(c: Column) -> Column:
    return F.coalesce(F.filter(c, lambda x: trim_all(x) != ""), F.array().cast("array<string>"))


def pay_of(v: Column) -> Column:
    """``struct<min,max,raw,source>`` in whole dollars a year; other currencies are left alone."""
    usd = F.coalesce(blank_to_null(v["listed_compensation_currency"]), F.lit("USD")) == "USD"
    ymin, ymax = v["yearly_min_compensation"], v["yearly_max_compensation"]
    yearly = ymin.isNotNull() | ymax.isNotNull()
    hmin, hmax = v["hourly_min_compensation"], v["hourly_max_compensation"]
    hourly = hmin.isNotNull() | hmax.isNotNull()
    lo = F.when(usd, F.when(yearly, js_round(ymin)).otherwise(js_round(hmin * PER_YEAR["hour"])))
    hi = F.when(usd, F.when(yearly, js_round(ymax)).otherwise(js_round(hmax * PER_YEAR["hour"])))
    money = lambda n: F.concat(F.lit("$"), grouped(n))
    return F.struct(
        lo.alias("min"), hi.alias("max"),
        F.coalesce(
            F.when(lo != hi, F.concat(money(lo), F.lit(" - "), money(hi))), money(lo), money(hi), F.lit("")
        ).alias("raw"),
        F.when(usd & yearly, f"{SOURCE}:yearly").when(usd & hourly, f"{SOURCE}:hourly").otherwise("").alias("source"),
    )


def travel_of(v: Column) -> Column:
    """Two travel words to 75 / 25 / 0 / null; the worse one counts."""
    air, land = or_empty(v["air_travel_requirement"]), or_empty(v["land_travel_requirement"])
    some = lambda p: air.rlike(p) | land.rlike(p)
    calm = lambda x: x.rlike(NONE) | (x == "")
    return F.when(some(TRAVEL_OFTEN), 75).when(some(TRAVEL_SOME), 25).when(calm(air) & calm(land) & some(NONE), 0)


def yoe_of(v: Column) -> Column:
    return F.when(v["is_min_industry_and_role_yoe_not_mentioned"].eqNullSafe(F.lit(False)),
                  v["min_industry_and_role_yoe"])


def clearance_of(v: Column) -> Column:
    c = blank_to_null(v["security_clearance"])
    return F.when(c.isNotNull(), ~c.rlike(NONE))


def sponsorship_of(v: Column) -> Column:
    return F.when(v["visa_sponsorship"].eqNullSafe(F.lit(True)), F.lit(False))


def workplace_of(raw: Column) -> Column:
    pairs = [F.lit(x) for kv in WORKPLACE.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), raw), F.lit("Unknown"))


def days_ago(millis: Column, now_ms: Column | int) -> Column:
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return F.when(millis.isNotNull(), F.greatest(F.floor((now - millis) / DAY_MS), F.lit(0))).cast("int")


def days_from_posted(code: Column | str) -> Column:
    """``r<seconds>`` to whole days, at least one."""
    secs = F.regexp_extract(or_empty(code), r"^r(\d+)\z", 1)
    return F.when(secs != "", F.greatest(js_round(secs.cast("double") / 86400), F.lit(1)))


def country_code(name: Column | str) -> Column:
    label = trim_all(or_empty(name))
    pairs = [F.lit(x) for kv in COUNTRIES.items() for x in kv]
    known = F.try_element_at(F.create_map(*pairs), F.lower(label))
    return F.when(label != "", F.coalesce(known, F.upper(F.left(label, F.lit(2)))))


def country_of(location: Column | str) -> Column:
    """Code of the country that a location names after its last comma, null when it names none that is known."""
    last = F.lower(trim_all(F.element_at(F.split(or_empty(location), ","), -1)))
    pairs = [F.lit(x) for kv in COUNTRIES.items() for x in kv]
    codes = F.array(*map(F.lit, sorted(set(COUNTRIES.values()))))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), last), F.when(F.array_contains(codes, F.upper(last)), F.upper(last)))


def assemble_description(body: Column, v: Column) -> Column:
    """``struct<description, source>``: full text or summary, then the structured lists as paragraphs."""
    full, summary = trim_all(or_empty(body)), trim_all(or_empty(v["requirements_summary"]))
    line = lambda label, xs: F.when(
        F.size(clean_list(xs)) > 0, F.concat(F.lit(label), F.array_join(clean_list(xs), ", ")))
    return F.struct(
        F.concat_ws(
            "\n\n",
            F.coalesce(blank_to_null(full), blank_to_null(summary)),
            line("Certifications / licences: ", v["licenses_or_certifications"]),
            line("Tools and systems: ", v["technical_tools"]),
            line("Role activities: ", v["role_activities"]),
        ).alias("description"),
        F.when(full != "", f"{SOURCE}:full").when(summary != "", f"{SOURCE}:summary").otherwise("none").alias("source"),
    )


def drop_expired(hits: DataFrame, hit: str = "hit") -> DataFrame:
    return hits.where(~F.coalesce(F.col(hit)["is_expired"], F.lit(False)))


def join_descriptions(hits: DataFrame, details: DataFrame, hit: str = "hit") -> DataFrame:
    """Pair each hit with its detail text by id (never by position); a missing text leaves the summary, of several the longest counts."""
    with_id = hits.withColumn("job_id", hit_id(F.col(hit)))
    text = details.groupBy("job_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("full_text"))
    return with_id.join(text, "job_id", "left")


def normalise_hit(
    hits: DataFrame, now_ms: int | None = None, hit: str = "hit", text: str = "full_text",
    fill_from_prose: bool = False,
) -> DataFrame:
    """Hits to postings. Rows without an id are dropped. Narrow: no shuffle.

    ``fill_from_prose`` fills null flags and years from the description text.
    """
    h = F.col(hit)
    v, info, co = h["v5_processed_job_data"], h["job_information"], h["enriched_company_data"]
    body = F.col(text) if text in hits.columns else F.lit("")
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    seq = F.col("seq") if "seq" in hits.columns else F.lit(None).cast("bigint")
    first = lambda *cs: F.coalesce(*[blank_to_null(c) for c in cs], F.lit(""))
    link = or_empty(h["apply_url"])
    staged = hits.withColumn("_id", hit_id(h)).where("_id is not null").withColumn("_pay", pay_of(v)).withColumn(
        "_d", assemble_description(body, v))
    out = staged.select(
        F.col("_id").alias("job_id"), link.alias("url"),
        first(info["title"], v["core_job_title"]).alias("title"),
        first(v["company_name"], co["name"]).alias("company"),
        or_empty(v["formatted_workplace_location"]).alias("location"),
        workplace_of(v["workplace_type"]).alias("workplace_type"),
        or_empty(v["workplace_type"]).alias("workplace_raw"),
        F.when(link != "", "external").otherwise("unknown").alias("apply_type"),
        link.alias("apply_url"),
        F.col("_d.description").alias("description"),
        F.length("_d.description").alias("description_chars"),
        F.col("_d.source").alias("description_source"),
        F.col("_pay.raw").alias("pay_raw"), F.col("_pay.min").alias("pay_min_annual"),
        F.col("_pay.max").alias("pay_max_annual"), F.col("_pay.source").alias("pay_source"),
        F.ceil(yoe_of(v)).cast("int").alias("yoe_min"), travel_of(v).alias("travel_pct"),
        clearance_of(v).alias("needs_clearance"), sponsorship_of(v).alias("sponsorship_unavailable"),
        F.lit(False).alias("remote_contradiction"),
        or_empty(v["seniority_level"]).alias("seniority"),
        F.array_join(clean_list(v["commitment"]), ", ").alias("employment_type"),
        or_empty(v["estimated_publish_date"]).alias("posted_raw"),
        days_ago(v["estimated_publish_date_millis"], now).alias("posted_days_ago"),
        F.lit(False).alias("reposted"), F.lit(False).alias("promoted"),
        F.lit(SOURCE).alias("source"), or_empty(h["source"]).alias("ats_source"),
        or_empty(h["board_token"]).alias("board_token"),
        F.coalesce(blank_to_null(h["strict_dedup_cluster_id"]), F.col("_id")).alias("dedup_key"),
        F.coalesce(h["is_expired"], F.lit(False)).alias("is_expired"),
        clean_list(v["licenses_or_certifications"]).alias("certifications"),
        clean_list(v["technical_tools"]).alias("tools"),
        first(v["company_website"], co["homepage_uri"]).alias("company_website"),
        seq.alias("seq"),
    )
    if fill_from_prose:
        flags = ["needs_clearance", "sponsorship_unavailable", "requires_relocation", "yoe_min", "travel_pct"]
        facts = extract_facts(out.select(
            *[F.col(c).alias(f"_s_{c}") if c in flags or c.startswith("pay_") else F.col(c) for c in out.columns]))
        filled = [F.coalesce(f"_s_{c}", c).alias(c) if f"_s_{c}" in facts.columns else F.col(c) for c in flags]
        kept = [F.col(f"_s_{c}").alias(c) if f"_s_{c}" in facts.columns else F.col(c)
                for c in out.columns if c not in flags]
        out = facts.select(*kept, *filled, "not_remote", "onsite_days_per_week", "flag_snippets")
    return as_postings(out)


def criteria(searches: DataFrame) -> DataFrame:
    """Saved searches (keywords, location, remote, posted) to typed criteria; no keywords, no row."""
    codes = F.create_map(*[x for k, ws in WORKPLACE_CODES.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    return searches.where(or_empty("keywords") != "").select(
        *[c for c in searches.columns if c not in ("keywords", "location", "remote", "posted")],
        col("keywords").alias("query"),
        country_code("location").alias("country"),
        F.try_element_at(codes, or_empty("remote")).alias("workplaces"),
        days_from_posted("posted").alias("max_days"),
    )


def criteria_filter(postings: DataFrame, one: dict) -> DataFrame:
    """One criteria record as predicates over postings; unknown workplace, age or country is kept."""
    out = postings
    if one.get("country"):
        named = F.coalesce(country_of("location"), F.lit(one["country"]))
        out = out.where(named == one["country"])
    for word in (one.get("query") or "").lower().split():
        hay = F.lower(F.concat_ws(" ", "title", "company", "description"))
        out = out.where(F.contains(hay, F.lit(word)))
    if one.get("workplaces"):
        wanted = [WORKPLACE[w] for w in one["workplaces"]]
        kind = F.coalesce("workplace_type", F.lit("Unknown"))
        out = out.where((kind == "Unknown") | kind.isin(*wanted))
    if one.get("max_days") is not None:
        out = out.where(F.col("posted_days_ago").isNull() | (F.col("posted_days_ago") <= one["max_days"]))
    return out
