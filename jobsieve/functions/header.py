"""Facts in a posting's header: meta line, pills, apply control, card words, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsieve.functions.facts import best_pay
from jobsieve.functions.regex import rx
from jobsieve.functions.text import blank_to_null, col, js_round, let, or_empty, squash, trim_all

# ---- Fixed values: words and patterns of a posting header ----
AGO = rx(r"(\d+){S}*(minute|min|hour|hr|day|week|month|year)s?{S}+ago", True)
APPLICANTS = rx(r"(over{S}+)?([\d,]+)\+?{S}*(applicant|people clicked apply|people have clicked)", True)
EMPLOYMENT = r"(?i)^(full-?time|part-?time|contract|temporary|internship|volunteer|other)$"
SENIORITY = r"(?i)^(internship|entry level|associate|mid-senior level|director|executive|not applicable)$"
PAY_PILL = rx(r"(\$|€|£|₹){S}?[\d,]+(\.\d+)?{S}*(k|K)?({S}*/{S}*(yr|year|hr|hour|mo|month))?")
MIDDOT = rx("{S}*[·•]{S}*")
DAYS_PER = {"minute": 0, "min": 0, "hour": 0, "hr": 0, "day": 1, "week": 7, "month": 30, "year": 365}
BOARD_DOMAIN = r"(?i)(^|\.)linkedin\.com$"
BOARD_JOB_URL = "https://www.linkedin.com/jobs/view/"
FOLLOWERS = rx(r"{S}*[\d,.]+[km]?\+?{S}*followers?{S}*\z", True)
NOT_A_TITLE = [
    r"\?$", rx("^get job alerts?{B}", True), rx("^job alerts?{B}", True), "(?i)^how promoted jobs are ranked",
    r"(?i)^\d+\+? results?$", "(?i)^about the (job|company|role)$", "(?i)^(job|role) description$",
    "(?i)^description$", "(?i)^people also viewed$", "(?i)^similar jobs$", rx("^more jobs{B}", True),
    rx("^premium{B}", True), rx(r"^\d+{S}+notifications?$", True), rx("^your profile{B}", True),
    "(?i)^meet the (hiring team|team)$", "(?i)^how (you|your profile) match",
]
ID_IN_HREF = [
    r"/jobs/view/(\d+)", r"[?&]currentJobId=(\d+)", r"[?&]jobId=(\d+)", r"/jobs/(\d{6,})",
]
ID_ATTRS = ("data-occludable-job-id", "data-job-id", "data-jobid")
URN_ATTRS = ("data-entity-urn", "data-urn", "data-tracking-urn")
CARD_KEY = r"job-card-component-ref-(\d+)"
PILL_PAY_CHARS, LOCATION_CHARS = 60, 90
# ---- end of fixed values ----


def ago_to_days(c: Column | str) -> Column:
    """ "3 weeks ago" to 21; minutes and hours are 0 days."""
    t = or_empty(c)
    unit = F.lower(F.regexp_extract(t, AGO, 2))
    per = F.try_element_at(F.create_map(*[F.lit(x) for kv in DAYS_PER.items() for x in kv]), unit)
    return (F.regexp_extract(t, AGO, 1).try_cast("int") * per).cast("int")


def parse_applicants(c: Column | str) -> Column:
    digits = F.replace(F.regexp_extract(or_empty(c), APPLICANTS, 2), F.lit(","), F.lit(""))
    return digits.try_cast("int")


def normalise_workplace(c: Column | str) -> Column:
    """Remote / Hybrid / On-site, or null when the text is none of them."""
    s = F.regexp_replace(F.lower(or_empty(c)), rx("{S}+"), "")
    return F.when(s == "remote", "Remote").when(s == "hybrid", "Hybrid").when(s.isin("onsite", "on-site"), "On-site")


def split_meta_line(meta: Column | str, company: Column | str) -> Column:
    """``struct<location, posted_raw, applicants, workplace>`` from a middot-separated line; first of each wins."""

    def classify(part):
        work = normalise_workplace(part)
        kind = (
            F.when(part.rlike(AGO), "posted").when(part.rlike(APPLICANTS), "applicants")
            .when(work.isNotNull(), "workplace").when(part == or_empty(company), "company")
            .when(F.length(part) < LOCATION_CHARS, "location")
        )
        return F.struct(kind.alias("kind"), part.alias("part"))

    parts = F.filter(F.transform(F.split(or_empty(meta), MIDDOT), trim_all), lambda p: p != "")

    def pick(ps):
        first = lambda kind: F.get(F.filter(ps, lambda p: p["kind"] == kind), F.lit(0))["part"]
        return F.struct(
            first("location").alias("location"), first("posted").alias("posted_raw"),
            parse_applicants(first("applicants")).alias("applicants"),
            normalise_workplace(first("workplace")).alias("workplace"),
        )

    return let(F.transform(parts, classify), pick)


def classify_pills(pills: Column | str) -> Column:
    """``struct<workplace, employment_type, seniority, salary>``; the first matching pill of each kind."""

    def classify(pill):
        kind = (
            F.when(normalise_workplace(pill).isNotNull(), "workplace").when(pill.rlike(EMPLOYMENT), "employment")
            .when(pill.rlike(SENIORITY), "seniority")
            .when(pill.rlike(PAY_PILL) & (F.length(pill) < PILL_PAY_CHARS), "pay")
        )
        return F.struct(kind.alias("kind"), pill.alias("pill"))

    def pick(ps):
        first = lambda kind: F.get(F.filter(ps, lambda p: p["kind"] == kind), F.lit(0))["pill"]
        return F.struct(
            normalise_workplace(first("workplace")).alias("workplace"), first("employment").alias("employment_type"),
            first("seniority").alias("seniority"), first("pay").alias("salary"),
        )

    none = F.array().cast("array<string>")
    return let(F.transform(F.transform(F.coalesce(col(pills), none), squash), classify), pick)


def workplace_fallback(stated: Column, top_text: Column | str, location: Column) -> Column:
    """Meta line or pill, then the word in the header, then "remote" in the location, else Unknown."""
    word = F.regexp_extract(or_empty(top_text), rx("{B}(remote|hybrid|on-?site){B}", True), 1)
    return F.coalesce(
        stated, normalise_workplace(word),
        F.when(or_empty(location).rlike(rx("{B}remote{B}", True)), "Remote"), F.lit("Unknown"))


def posted_fallback(posted: Column, top_text: Column | str) -> Column:
    return F.coalesce(posted, F.regexp_extract(or_empty(top_text), AGO, 0))


def is_reposted(meta: Column | str, top_text: Column | str) -> Column:
    return or_empty(meta).rlike("(?i)reposted") | or_empty(top_text).rlike("(?i)reposted")


def card_flags(card_text: Column | str) -> Column:
    t = or_empty(card_text)
    return F.struct(t.rlike(rx("{B}Promoted{B}")).alias("promoted"), t.rlike(rx("{B}Viewed{B}")).alias("viewed"))


def pay_precedence(salary: Column | str, prose_pay: Column) -> Column:
    """A pay pill beats prose; ``pay_source`` says which won."""

    def choose(pill):
        use = pill["pay_min"].isNotNull()
        names = ["pay_raw", "pay_min", "pay_max", "pay_period", "pay_currency", "pay_min_annual", "pay_max_annual"]
        return F.struct(
            *[F.when(use, pill[n]).otherwise(prose_pay[n]).alias(n) for n in names],
            F.when(use, "pill").when(prose_pay["pay_min"].isNotNull(), "jd").otherwise("").alias("pay_source"),
        )

    return let(best_pay(or_empty(salary)), choose)


def remote_contradiction(workplace: Column | str, not_remote: Column | str, onsite: Column | str) -> Column:
    says_no = F.coalesce(col(not_remote), F.lit(False)) | (F.coalesce(col(onsite), F.lit(0)) >= 1)
    return (or_empty(workplace) == "Remote") & says_no


def apply_type(notice: Column | str, text: Column | str, aria: Column | str) -> Column:
    """closed / easy_apply / applied / external / unknown, in that order of precedence."""
    label = F.lower(F.concat_ws(" ", or_empty(text), or_empty(aria)))
    return (
        F.when(F.lower(or_empty(notice)).rlike("no longer accepting|closed"), "closed")
        .when(F.contains(label, F.lit("easy apply")), "easy_apply")
        .when(F.contains(label, F.lit("applied")), "applied")
        .when(F.contains(label, F.lit("apply")), "external")
        .otherwise("unknown")
    )


def host_of(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def external_href(href: Column | str) -> Column:
    """An absolute link that leaves the board, else an empty string."""
    h = or_empty(href)
    leaves = h.rlike("(?i)^https?://") & ~F.coalesce(host_of(h).rlike(BOARD_DOMAIN), F.lit(True))
    return F.when(leaves, h).otherwise("")


def host_label(url: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(host_of(url), r"^www\.", ""), F.substring(col(url), 1, 40))


def company_text(c: Column | str) -> Column:
    """Company name without a trailing follower count."""
    return F.trim(F.regexp_replace(squash(or_empty(c)), FOLLOWERS, ""))


def looks_like_title(c: Column | str) -> Column:
    t = or_empty(c)
    furniture = reduce(lambda a, b: a | b, [t.rlike(p) for p in NOT_A_TITLE])
    return F.length(t).between(3, 120) & ~furniture


def pay_tag(currency: Column, lo: Column, hi: Column, period: Column, source: Column) -> Column:
    """Short label such as ``$120k-$150k/yr (JD)``."""
    plain = lambda n: F.regexp_replace(n.cast("string"), r"\.0$", "")
    k = lambda n: F.when(n >= 1000, F.concat(js_round(n / 1000).cast("string"), F.lit("k"))).otherwise(plain(n))
    cur = F.when(F.length(or_empty(currency)) == 1, or_empty(currency)).otherwise("")
    span = F.when(hi.isNotNull(), F.concat(k(lo), F.lit("-"), cur, k(hi))).otherwise(k(lo))
    short = F.when(period == "year", "yr").when(period == "hour", "hr").otherwise(period)
    per = F.when(or_empty(period) != "", F.concat(F.lit("/"), short)).otherwise("")
    return F.concat(cur, span, per, F.when(or_empty(source) == "jd", " (JD)").otherwise(""))


def job_id_from_href(href: Column | str) -> Column:
    h = or_empty(href)
    return F.coalesce(*[blank_to_null(F.regexp_extract(h, p, 1)) for p in ID_IN_HREF])


def job_id_from_attrs(attrs: Column | str) -> Column:
    """Own id attribute, then a posting urn, then the link; a card's component key last."""
    a = col(attrs)
    get = lambda name: F.try_element_at(a, F.lit(name))
    direct = F.trim(F.coalesce(*[blank_to_null(get(n)) for n in ID_ATTRS]))
    urn = F.coalesce(*[blank_to_null(get(n)) for n in URN_ATTRS])
    return F.coalesce(
        F.when(direct.rlike(r"^\d+$"), direct),
        blank_to_null(F.regexp_extract(urn, r"jobPosting:(\d+)", 1)),
        job_id_from_href(get("href")),
    )


def card_key(attrs: Column | str) -> Column:
    """Id of a card on the layout that keys its cards by component reference."""
    return blank_to_null(F.regexp_extract(F.try_element_at(col(attrs), F.lit("componentkey")), CARD_KEY, 1))


def thin_reason(description: Column | str, title: Column | str, company: Column | str) -> Column:
    """The first reason a row is too thin to trust, else null."""
    n = F.length(or_empty(description))
    return (
        F.when(n < 200, F.concat(F.lit("description was "), n.cast("string"), F.lit(" characters")))
        .when(or_empty(title) == "", "no title")
        .when(~looks_like_title(title), F.concat(F.lit('the title came out as "'), F.left(col(title), F.lit(40)), F.lit('"')))
        .when(or_empty(company) == "", "no company")
    )
