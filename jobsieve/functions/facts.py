"""Facts stated in posting prose: pay, years, travel, office days, eligibility flags.

Every parser fails closed: an unclear signal is null, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.regex import rx
from jobsieve.functions.spans import find_spans, first_start
from jobsieve.functions.text import Sliced, clip, col, js_round, let, sliced, snippet, squash

# ---- Fixed values: words, patterns and factors that must equal the reference for equal results ----
WRITTEN = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}
CURRENCY_CODES = "USD|CAD|AUD|NZD|EUR|GBP|INR|SGD|CHF"
PERIOD_WORDS = {
    "annually": "year", "annualized": "year", "annum": "year", "yearly": "year", "year": "year", "yr": "year",
    "hourly": "hour", "hour": "hour", "hr": "hour",
    "monthly": "month", "month": "month", "mo": "month",
    "weekly": "week", "week": "week", "wk": "week",
    "daily": "day", "day": "day",
}
PER_YEAR = {"year": 1, "month": 12, "week": 52, "day": 260, "hour": 2080}

MONEY = rx(
    r"(?![a-z]|[ -#%-/:-@](?!\d))(?:(" + CURRENCY_CODES + r"){S}*)?([$€£₹])?{S}?"
    r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d{1,2})?){S}*(k|K)?"
)
STRICT_K_MONEY = MONEY.replace("(k|K)?", "((?:k|K)(?![A-Za-z0-9_]))?")
RANGE_GAP = rx(
    r"^{S}*(?:/?{S}*(?:yr|year|hr|hour|mo|month|wk|week|day){S}*)?(?:-|–|—|to|through|up to){S}*\z", True
)
NOT_PAY_AFTER = rx(r"^{S}*(?:million|billion|bn{B}|mm{B})", True)
NOT_PAY_NEAR = rx(
    r"(?=[abcdfgimprv4][aenorsuw0])(?:revenue|funding|raised|valuation|market cap|budget of|assets under|in sales|grant|award of"
    r"|deductible|premium of|401{S}*\(?k\)?|copay)", True
)
PAY_CUE = rx(
    r"(?=[abcehprstw][aenox]|/)(?:salar(?:y|ies)|compensation|pay (?:range|rate|band)|base (?:pay|salary)|hourly rate|rate of pay"
    r"|remuneration|total (?:rewards|compensation)|annual(?:ized)? (?:pay|rate)|per (?:year|hour)|/{S}*[yh]r"
    r"|expected pay|target pay|wage)", True
)
YEARS_NUMERIC = rx(
    r"(\d{1,2}){S}*(\+|plus)?{S}*(?:(?:-|–|—|to){S}*(\d{1,2}){S}*(?:\+|plus)?{S}*)?(?:years?|yrs?\.?){B}", True
)
YEARS_WRITTEN = rx(
    r"(?=[efnost])(?<!{W})(" + "|".join(WRITTEN) + r")(?!{W}){S}*(?:\({S}*\d{1,2}{S}*\){S}*)?(?:years?|yrs?\.?){B}", True
)
YEARS_CUE = rx(
    "experien|background|track record|proven|worked|working|expertise|tenure|minimum of|at least|required"
    "|requirement|qualif", True
)
YEARS_QUALIFIER = rx(r"^{S}*(?:of|in|as|with|within|working|doing|supporting|managing|monitoring){B}", True)
YEARS_REJECT = rx(
    r"over the (?:past|last)|(?:past|last|next|coming) (?:\d{1,2}|few|several) years?|in business|founded"
    r"|anniversary|history|age of|older than|within \d{1,2} years|every \d{1,2} years", True
)
FLAGS = {
    "needs_clearance": rx(
        r"(?=[acdpst])(?<!{W})(?:security clearance|active clearance|ts{S}*/{S}*sci|top secret|secret clearance|public trust"
        r"|dod clearance|clearance (?:is )?required)(?!{W})", True),
    "sponsorship_unavailable": rx(
        r"(?=[cdgmnuw])(?<!{W})(?:no sponsorship|not (?:able to )?sponsor|cannot sponsor|unable to sponsor"
        r"|without (?:the need for )?sponsorship|do(?:es)? not (?:offer|provide) sponsorship"
        r"|must be (?:a )?u\.?s\.?{S}*citizen|u\.?s\.?{S}*citizenship (?:is )?required"
        r"|citizenship (?:is )?required|green card holder)(?!{W})", True),
    "requires_relocation": rx(
        r"(?=[amrw])(?<!{W})(?:must relocate|required to relocate|relocation (?:is )?required|willing(?:ness)? to relocate"
        r"|able to relocate)(?!{W})", True),
    "not_remote": rx(
        r"(?=[1fmnrt])(?<!{W})(?:not a remote (?:position|role|job)|this (?:position|role) is not remote|no remote work"
        r"|remote work is not (?:available|an option)|fully on-?site|100%{S}*on-?site"
        r"|must (?:work )?(?:on-?site|in (?:the )?office))(?!{W})", True),
}
TRAVEL = [
    rx(r"travel[^.\n]{0,60}?(\d{1,3}){S}*%", True),
    rx(r"(\d{1,3}){S}*%[^.\n]{0,40}?travel", True),
]
OFFICE = "(?:office|on-?site|onsite|in person|in-person|hq)"
ONSITE = [
    rx(r"(\d|one|two|three|four|five){S}*(?:-{S}*\d{S}*)?days?{S}*(?:per|a|each|/){S}*week[^.\n]{0,45}?" + OFFICE, True),
    rx(OFFICE + r"[^.\n]{0,45}?(\d|one|two|three|four|five){S}*days?{S}*(?:per|a|each|/){S}*week", True),
]
# ---- end of fixed values ----

_MONEY_HINT = rx(r"(?![a-z -#%-/:-@])(?:[$€£₹]|\d,\d{3}|\d{S}*[kK]|" + CURRENCY_CODES + ")")
_YEARS_HINT = "(?i)year|yr"
_PERIOD_AT_END = r"[A-Za-z]+\z"
_PERIOD_IN_TAIL = rx(r"(?s)^.*?{B}(" + "|".join(sorted(PERIOD_WORDS, key=len, reverse=True)) + "){B}", True)


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def written_number(c: Column | str) -> Column:
    """Digits (with commas) or one..twelve to a number; anything else null."""
    s = F.lower(squash(c))
    return F.coalesce(_lookup(WRITTEN, s).cast("double"), F.replace(s, F.lit(","), F.lit("")).try_cast("double"))


def annualise(value: Column, period: Column) -> Column:
    return js_round(value * _lookup(PER_YEAR, period))


def plausible_pay(value: Column, period: Column) -> Column:
    ok = (
        F.when(period == "hour", value.between(7, 500))
        .when(period == "day", value.between(50, 5000))
        .otherwise(annualise(value, period).between(10_000, 2_000_000))
    )
    return F.coalesce(ok, F.lit(False))


def money_mentions(text: Column | str, strict_k: bool = False) -> Column:
    """Money-like tokens in text order; unmarked ungrouped numbers are dropped."""
    pat = STRICT_K_MONEY if strict_k else MONEY

    def token(s):
        raw = F.regexp_extract(s["m"], pat, 3)
        k = F.regexp_extract(s["m"], pat, 4) != ""
        code, sym = F.regexp_extract(s["m"], pat, 1), F.regexp_extract(s["m"], pat, 2)
        value = F.replace(raw, F.lit(","), F.lit("")).cast("double")
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            (value * F.when(k, 1000.0).otherwise(1.0)).alias("value"),
            sym.alias("sym"), code.alias("code"),
            ((sym != "") | (code != "") | k).alias("marked"),
            F.contains(raw, F.lit(",")).alias("comma_grouped"),
            squash(s["m"]).alias("raw"),
        )

    return F.filter(
        F.transform(find_spans(text, pat, _MONEY_HINT, keep="[$€£₹,kKA-Z]"), token), lambda t: t["marked"] | t["comma_grouped"]
    )


def pair_ranges(text: Column | str | Sliced, tokens: Column) -> Column:
    """Each token with the next one attached when only a range word lies between them."""
    t = text if isinstance(text, Sliced) else col(text)

    def attach(ts):
        def one(a, i):
            b = F.get(ts, i + 1)
            near = b.isNotNull() & (b["start"] - a["end"] <= 20)
            is_range = F.coalesce(near & clip(t, a["end"], b["start"]).rlike(RANGE_GAP), F.lit(False))
            return F.struct(
                a.alias("a"), is_range.alias("is_range"),
                F.when(is_range, F.least(a["value"], b["value"])).otherwise(a["value"]).alias("lo"),
                F.when(is_range, F.greatest(a["value"], b["value"])).alias("hi"),
                F.when(is_range, b["end"]).otherwise(a["end"]).alias("tail"),
            )

        return F.transform(ts, one)

    return let(tokens, attach)


def veto_pay(text: Column | Sliced, start: Column, tail: Column) -> Column:
    """True when the number is clearly somebody else's money."""
    return clip(text, tail, tail + 30).rlike(NOT_PAY_AFTER) | clip(text, start - 45, tail + 30).rlike(NOT_PAY_NEAR)


def cue_pay(text: Column | Sliced, start: Column, tail: Column) -> Column:
    return clip(text, start - 160, tail + 90).rlike(PAY_CUE)


def pay_period(after: Column, probe: Column) -> Column:
    """``struct<period, explicit, upto>``: stated right after the figure, else inferred from size, else null."""

    def read(upto):
        # The match ends with the word: the first that fits, longest first, so it is the longest that ends the match.
        stated = F.when(upto != "", _lookup(PERIOD_WORDS, F.lower(F.regexp_extract(upto, _PERIOD_AT_END, 0))))
        return let(stated, lambda s: F.struct(
            F.coalesce(s, F.when(probe >= 1000, "year").when(probe <= 200, "hour")).alias("period"),
            s.isNotNull().alias("explicit"), F.length(upto).alias("upto")))

    return let(F.regexp_extract(after, _PERIOD_IN_TAIL, 0), read)


def pay_candidates(text: Column | str, strict_k: bool = False) -> Column:
    """Every plausible pay statement with its score, in text order."""
    tokens = money_mentions(text, strict_k)
    return sliced(col(text), lambda t: _score_pay(t, tokens))


def _score_pay(t: Sliced, tokens: Column) -> Column:

    def judge(p):
        start = p["a"]["start"]
        return F.struct(
            p.alias("p"),
            cue_pay(t, start, p["tail"]).alias("cue"),
            pay_period(clip(t, p["tail"], p["tail"] + 30), F.coalesce(p["hi"], p["lo"])).alias("per"),
        )

    def keep(j):
        p, per = j["p"], j["per"]["period"]
        return (
            (p["a"]["marked"] | j["cue"])
            & per.isNotNull()
            & plausible_pay(p["lo"], per)
            & (p["hi"].isNull() | plausible_pay(p["hi"], per))
        )

    def shape(j):
        p, per = j["p"], j["per"]
        a = p["a"]
        currency = F.coalesce(F.nullif(a["code"], F.lit("")), a["sym"])
        score = (
            j["cue"].cast("int") * 3 + p["is_range"].cast("int") * 2 + per["explicit"].cast("int")
            + (currency != "").cast("int")
        )
        return F.struct(
            score.alias("score"), (-a["start"]).alias("neg_start"),
            p["lo"].alias("pay_min"), p["hi"].alias("pay_max"), per["period"].alias("pay_period"),
            currency.alias("pay_currency"),
            squash(clip(t, a["start"], p["tail"] + per["upto"])).alias("pay_raw"),
        )

    pairs = F.filter(
        pair_ranges(t, tokens), lambda p: ~veto_pay(t, p["a"]["start"], p["tail"])
    )
    return F.transform(F.filter(F.transform(pairs, judge), keep), shape)


def best_pay(text: Column | str, strict_k: bool = False) -> Column:
    """The best-supported pay statement as a struct of seven columns; the first one wins a tie."""

    def finish(b):
        return F.struct(
            F.coalesce(b["pay_raw"], F.lit("")).alias("pay_raw"),
            b["pay_min"].alias("pay_min"), b["pay_max"].alias("pay_max"),
            F.coalesce(b["pay_period"], F.lit("")).alias("pay_period"),
            F.coalesce(b["pay_currency"], F.lit("")).alias("pay_currency"),
            annualise(b["pay_min"], b["pay_period"]).alias("pay_min_annual"),
            annualise(b["pay_max"], b["pay_period"]).alias("pay_max_annual"),
        )

    return let(F.array_max(pay_candidates(text, strict_k)), finish)


def years_mentions(text: Column | str) -> Column:
    """Stated years of experience, numeric mentions first and then written ones."""
    text = col(text)

    def judge(pattern, t):
        def one(s):
            context = clip(t, s["start"] - 70, s["end"] + 100)
            plus = F.regexp_extract(s["m"], pattern, 2) != "" if pattern is YEARS_NUMERIC else F.lit(False)
            years = written_number(F.regexp_extract(s["m"], pattern, 1)).cast("int")
            ok = ~context.rlike(YEARS_REJECT) & (
                plus | clip(t, s["end"], s["end"] + 20).rlike(YEARS_QUALIFIER) | context.rlike(YEARS_CUE)
            )
            return F.struct(
                F.when(ok & years.between(0, 25), years).alias("years"),
                snippet(t, s["start"], s["end"], 45).alias("snippet"),
            )

        return F.transform(find_spans(text, pattern, _YEARS_HINT), one)

    both = sliced(text, lambda t: F.concat(judge(YEARS_NUMERIC, t), judge(YEARS_WRITTEN, t)))
    return F.filter(both, lambda y: y["years"].isNotNull())


def years_required(mentions: Column | str) -> Column:
    """The binding requirement: the largest of the stated ones."""
    return F.array_max(F.transform(col(mentions), lambda y: y["years"]))


def _max_number(text: Column, patterns: list[str], cap: int) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    return F.array_max(F.filter(F.transform(found, lambda s: written_number(s).cast("int")), lambda n: n <= cap))


def travel_pct(text: Column | str) -> Column:
    t = col(text)
    return F.when(t.rlike("(?i)travel") & F.contains(t, F.lit("%")), _max_number(t, TRAVEL, 100))


def onsite_days(text: Column | str) -> Column:
    t = col(text)
    return F.when(t.rlike("(?i)days?" + rx("{S}") + "*(?:per|a|each|/)"), _max_number(t, ONSITE, 7))


def flag(text: Column | str, name: str) -> Column:
    return F.coalesce(col(text).rlike(FLAGS[name]), F.lit(False))


def flag_snippets(text: Column | str) -> Column:
    """``map<flag, surrounding text>`` for the flags that are set."""
    t = col(text)

    def entry(name):
        start = first_start(t, FLAGS[name])
        end = start + F.length(F.regexp_extract(t, FLAGS[name], 0))
        return F.when(flag(t, name), F.struct(F.lit(name).alias("key"), snippet(t, start, end, 45).alias("value")))

    return F.map_from_entries(F.array_compact(F.array(*[entry(n) for n in FLAGS])))


def extract_facts(df: DataFrame, text: str = "description", strict_k: bool = False) -> DataFrame:
    """Add every prose fact as columns. Narrow: no shuffle, no Python worker."""
    t = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumn("_t", t).withColumn("_pay", best_pay("_t", strict_k)).withColumn("_y", years_mentions("_t"))
    pay = [F.col("_pay")[c].alias(c) for c in (
        "pay_raw", "pay_min", "pay_max", "pay_period", "pay_currency", "pay_min_annual", "pay_max_annual")]
    return staged.select(
        *[F.col(c) for c in df.columns],
        *pay,
        years_required("_y").alias("yoe_min"),
        F.slice("_y", 1, 6).alias("yoe_mentions"),
        *[flag("_t", n).alias(n) for n in FLAGS],
        travel_pct("_t").alias("travel_pct"),
        onsite_days("_t").alias("onsite_days_per_week"),
        flag_snippets("_t").alias("flag_snippets"),
    )


def mention_rows(df: DataFrame, mentions: Column, *keep: str) -> DataFrame:
    """One row per mention, with its place in the text order."""
    # The outer form keeps the optimizer from adding a size check that would evaluate the mentions again.
    rows = df.select(*keep, F.posexplode_outer(mentions).alias("mention_no", "mention"))
    return rows.where("mention is not null").select(*keep, "mention_no", "mention.*")
