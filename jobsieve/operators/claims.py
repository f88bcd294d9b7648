"""Model-reply tables: what to ask, what came back, and what of it stands on the page word for word.

No model is called here; replies are rows somebody else collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.facts import best_pay
from jobsieve.functions.regex import rx
from jobsieve.functions.replies import first_json_object, reply_text, stated_value, strip_reasoning
from jobsieve.functions.text import or_empty, squash, squash_lower
from jobsieve.operators.outline import BROAD, RULES

# ---- Fixed values: fields a model may fill, and how each is checked ----
WORKPLACES = ["Remote", "Hybrid", "On-site"]
EMPLOYMENTS = ["Full-time", "Part-time", "Contract", "Temporary", "Internship", "Volunteer", "Other"]
SENIORITIES = ["Internship", "Entry level", "Associate", "Mid-Senior level", "Director", "Executive"]
ROUTES = ["easy_apply", "external", "unknown"]
FIELDS = {
    "title": {"max_len": 160}, "company": {"max_len": 120}, "location": {"max_len": 120},
    "workplaceType": {"one_of": WORKPLACES}, "employmentType": {"one_of": EMPLOYMENTS},
    "seniority": {"one_of": SENIORITIES}, "payText": {"max_len": 80}, "applyRoute": {"one_of": ROUTES},
}
COLUMN_OF = {
    "title": "title", "company": "company", "location": "location", "workplaceType": "workplace_type",
    "employmentType": "employment_type", "seniority": "seniority", "applyRoute": "apply_type",
}
DECLINED = "(?i)^(null|none|n/a|unknown|not stated)$"
ROUTE_EVIDENCE = {"easy_apply": rx("easy{S}*apply", True), "external": rx("{B}apply{B}", True)}
SAMPLE_CHARS = 4000
CALLS_PER_RUN = 30
MAX_SELECTOR, MAX_NOTES = 300, 400
# ---- end of fixed values ----

# What a model is told; wording is ours and may be replaced by the caller.
ASK = {
    "title": "the job title as printed", "company": "the employer's name only",
    "location": "the location line as printed", "workplaceType": "one of " + ", ".join(WORKPLACES),
    "employmentType": "one of " + ", ".join(EMPLOYMENTS), "seniority": "one of " + ", ".join(SENIORITIES),
    "payText": "the pay range as printed", "applyRoute": "one of " + ", ".join(ROUTES),
}
FIELD_PROMPT = (
    "Read one job page and answer with a single JSON object holding the fields below. Copy every value from the "
    "text letter for letter and use null where the text is silent; anything not on the page will be discarded.")
LAYOUT_PROMPT = (
    "Read the outline of a job list page and answer with a single JSON object that maps the parts below to CSS "
    "selectors. Leave out what the outline does not show; each selector is tested on the page before use.")


def field_gaps(postings: DataFrame) -> DataFrame:
    """Add ``gaps``: the fields a posting still lacks."""
    blank = lambda c: or_empty(c) == ""
    lacks = {
        "title": blank("title"), "company": blank("company"), "location": blank("location"),
        "workplaceType": blank("workplace_type") | (F.col("workplace_type") == "Unknown"),
        "employmentType": blank("employment_type"), "seniority": blank("seniority"),
        "payText": F.col("pay_min_annual").isNull() & blank("pay_raw"),
        "applyRoute": blank("apply_type") | (F.col("apply_type") == "unknown"),
    }
    return postings.withColumn("gaps", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in lacks.items()])))


def prompt_sample(header: Column | str, description: Column | str, cap: int = SAMPLE_CHARS) -> Column:
    """Header plus as much of the description as the cap leaves room for."""
    head = squash(or_empty(header))
    room = F.greatest(F.lit(cap) - F.length(head) - 2, F.lit(0))
    body = F.substring(squash(or_empty(description)), F.lit(1), room)
    return F.regexp_replace(F.concat(head, F.lit("\n\n"), body), rx(r"^{S}+|{S}+\z"), "")


def _messages(system: Column, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")))


def build_messages(df: DataFrame, sample: str = "sample", gaps: str = "gaps") -> DataFrame:
    """Add ``messages`` asking for the missing fields only (all of them when none is listed)."""
    asks = F.create_map(*[F.lit(x) for kv in ASK.items() for x in kv])
    every = F.array(*[F.lit(k) for k in FIELDS])
    wanted = F.when(F.size(gaps) > 0, F.col(gaps)).otherwise(every)
    lines = F.transform(F.filter(wanted, lambda k: F.try_element_at(asks, k).isNotNull()),
                        lambda k: F.concat(F.lit('  "'), k, F.lit('": '), F.try_element_at(asks, k)))
    system = F.concat(F.lit(FIELD_PROMPT + "\n"), F.array_join(lines, "\n"))
    return df.withColumn("messages", _messages(system, F.concat(F.lit("JOB PAGE TEXT\n\n"), or_empty(sample))))


def build_layout_messages(df: DataFrame, digest: str = "digest", reason: str = "reason") -> DataFrame:
    """Add ``messages`` asking where the parts of an unknown layout are."""
    parts = "\n".join(f'  "{k}"' + (f" (at least {r['min']} matches)" if r["min"] > 1 else "") for k, r in RULES.items())
    why = F.when(or_empty(reason) != "", F.concat(F.lit("Why this is being asked: "), reason)).otherwise(
        "Resolve this page.")
    user = F.concat_ws("\n", why, F.lit(""), F.lit("PAGE OUTLINE"), or_empty(digest))
    return df.withColumn("messages", _messages(F.lit(LAYOUT_PROMPT + "\n" + parts), user))


def read_replies(replies: DataFrame, body: str = "body") -> DataFrame:
    """Add ``text``: the reply's words wherever its provider put them."""
    return replies.withColumn("text", reply_text(body))


def _with_json(df: DataFrame, text: str) -> DataFrame:
    cleaned = df.withColumn("_clean", strip_reasoning(text))
    # Only replies that hold a brace at all go through the Python helper's brace matching.
    obj = first_json_object(F.when(F.contains("_clean", F.lit("{")), F.col("_clean")))
    staged = cleaned.withColumn("_json", obj).withColumn("_doc", F.try_parse_json("_json"))
    return staged.withColumn(
        "_error",
        F.when(F.col("_json").isNull(), "no JSON object in the reply")
        .when(F.col("_doc").isNull(), "reply was not valid JSON")
        .when(~F.startswith(F.schema_of_variant("_doc"), F.lit("OBJECT")), "reply was not a JSON object"))


def parse_fields(replies: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fields`` (the known keys with a value) and ``error``."""
    staged = _with_json(replies, text)
    entries = F.array(*[
        F.struct(F.lit(k).alias("key"), stated_value(F.col("_doc"), k).alias("value")) for k in FIELDS])
    fields = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return staged.select(*replies.columns, F.when(F.col("_error").isNull(), fields).alias("fields"),
                         F.col("_error").alias("error_why"))


def clean_selector(doc: Column, key: str) -> Column:
    """A usable selector: a string, or an array of strings joined by commas; else null."""
    v = F.try_variant_get(doc, f"$.{key}", "variant")
    kind = F.schema_of_variant(v)
    many = F.try_variant_get(doc, f"$.{key}", "array<variant>")
    strings = F.transform(F.filter(many, lambda x: F.schema_of_variant(x) == "STRING"),
                          lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    s = F.trim(F.when(kind == "STRING", F.try_variant_get(doc, f"$.{key}", "string")).when(
        F.startswith(kind, F.lit("ARRAY")), F.array_join(F.filter(strings, lambda x: x != ""), ", ")))
    bad = (s == "") | (F.length(s) > MAX_SELECTOR) | s.rlike("[\n\r]") | s.rlike(
        "(?i)^(?:null|none|n/a|undefined)$") | F.lower(s).isin(*BROAD)
    return F.when(~bad, s)


def parse_plan(replies: DataFrame, text: str = "text") -> DataFrame:
    """Add ``plan`` (part to selector), ``notes`` and ``error_why``; a wrapped answer is unwrapped."""
    staged = _with_json(replies, text)
    doc = F.col("_doc")
    inner = lambda k: F.try_variant_get(doc, f"$.{k}", "variant")
    is_obj = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    staged = staged.withColumn(
        "_in", F.when(is_obj(inner("selectors")), inner("selectors")).when(is_obj(inner("plan")), inner("plan"))
        .otherwise(doc))
    entries = F.array(*[
        F.struct(F.lit(k).alias("key"), clean_selector(F.col("_in"), k).alias("value")) for k in RULES])
    staged = staged.withColumn("_plan", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))
    error = F.coalesce("_error", F.when(F.size("_plan") == 0, "the reply named no usable selector"))
    notes = F.coalesce(*[
        F.when(F.schema_of_variant(F.try_variant_get(d, "$.notes", "variant")) == "STRING",
               F.nullif(F.try_variant_get(d, "$.notes", "string"), F.lit(""))) for d in (doc, F.col("_in"))])
    return staged.select(
        *replies.columns, F.when(error.isNull(), F.col("_plan")).alias("plan"),
        F.when(error.isNull(), F.substring(squash(or_empty(notes)), 1, MAX_NOTES)).alias("notes"),
        error.alias("error_why"))


def _rules() -> Column:
    """The field table as one literal map: length bound, allowed values by lower-case spelling, their list."""
    none = F.lit(None)
    rows = []
    for name, rule in FIELDS.items():
        options = rule.get("one_of")
        table = F.create_map(*[F.lit(x) for o in options for x in (o.lower(), o)]) if options else none
        rows += [F.lit(name), F.struct(
            F.lit(rule.get("max_len")).cast("int").alias("max_len"), table.cast("map<string,string>").alias("one_of"),
            F.lit("/".join(options) if options else None).cast("string").alias("options"))]
    return F.create_map(*rows)


def _judge(e: Column, page: Column, have: Column) -> Column:
    """``struct<field,value,why,declined>``; why is null when the claim stands. The first failing rule names it."""
    key, value, rule, match = e["key"], e["value"], e["rule"], e["match"]
    taken = or_empty(F.try_element_at(have, key)) != ""
    listed = rule["options"].isNotNull()
    said = stands_in(F.coalesce(match, value), page)
    route = key == "applyRoute"
    unproven = ((match == "easy_apply") & ~page.rlike(ROUTE_EVIDENCE["easy_apply"])) | (
        (match == "external") & ~page.rlike(ROUTE_EVIDENCE["external"]))
    why = (
        F.when(rule.isNull(), "not a field the model may fill")
        .when(taken, "already read from the page")
        .when(F.length(value) > rule["max_len"], F.concat(F.lit("longer than a "), key, F.lit(" can be")))
        .when(listed & match.isNull(), F.concat(F.lit("not one of "), rule["options"]))
        .when(route & unproven, "nothing on the page says so")
        .when(listed & ~route & ~said, "the page does not say it")
        .when(~listed & ~said, "not found in the page text"))
    return F.struct(
        key.alias("field"), F.when(taken, value).otherwise(F.coalesce(match, value)).alias("value"), why.alias("why"),
        (rule.isNotNull() & ((value == "") | value.rlike(DECLINED))).alias("declined"))


def stands_in(value: Column, page: Column) -> Column:
    """Whether ``page``, lower case with single spaces, says ``value`` word for word."""
    return F.contains(page, F.lower(value))


def verify_claims(claims: DataFrame, fields: str = "fields", sample: str = "sample", current: str = "current") -> DataFrame:
    """Add ``accepted`` (map) and ``rejected`` (field, value, why). Each row checks itself: no shuffle."""
    staged = claims.withColumn("_page", squash_lower(or_empty(sample)))
    none = F.create_map().cast("map<string,string>")
    rules = _rules()
    claimed = F.transform(F.map_entries(F.coalesce(F.col(fields), none)), lambda e: F.struct(
        e["key"].alias("key"), squash(or_empty(e["value"])).alias("value"), F.try_element_at(rules, e["key"]).alias("rule")))
    matched = F.transform(claimed, lambda e: F.struct(
        e["key"].alias("key"), e["value"].alias("value"), e["rule"].alias("rule"),
        F.try_element_at(e["rule"]["one_of"], F.lower(e["value"])).alias("match")))
    judged = F.transform(matched, lambda e: _judge(e, F.col("_page"), F.coalesce(F.col(current), none)))
    staged = staged.withColumn("_j", F.filter(judged, lambda j: ~j["declined"]))
    good = F.filter("_j", lambda j: j["why"].isNull())
    bad = F.filter("_j", lambda j: j["why"].isNotNull())
    return staged.select(
        *claims.columns,
        F.map_from_entries(F.transform(good, lambda j: F.struct(j["field"], j["value"]))).alias("accepted"),
        F.transform(bad, lambda j: F.struct(j["field"].alias("field"), j["value"].alias("value"), j["why"].alias("why")))
        .alias("rejected"))


def current_fields() -> Column:
    """What a posting already states, in claim vocabulary."""
    unknown = lambda c, u: F.when(F.col(c) != u, F.col(c))
    return F.create_map(
        F.lit("title"), F.col("title"), F.lit("company"), F.col("company"), F.lit("location"), F.col("location"),
        F.lit("workplaceType"), unknown("workplace_type", "Unknown"), F.lit("employmentType"), F.col("employment_type"),
        F.lit("seniority"), F.col("seniority"), F.lit("payText"), F.col("pay_raw"),
        F.lit("applyRoute"), unknown("apply_type", "unknown"))


def apply_claims(postings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Fill gaps with accepted values (``job_id, model, accepted``) and record which model filled what.

    Pay text is parsed like prose and dropped when it does not parse.
    """
    # Several accepted rows of an id: the first model in rank, or in name without ranks, fills the gaps.
    rank = F.col("model_rank") if "model_rank" in accepted.columns else F.lit(0)
    claims = accepted.groupBy("job_id").agg(F.min_by(F.struct("model", "accepted"), F.struct(rank, "model")).alias("_c")).select(
        "job_id", F.col("_c.model").alias("_model"), F.col("_c.accepted").alias("_acc"))
    j = postings.join(claims, "job_id", "left")
    get = lambda k: F.try_element_at("_acc", F.lit(k))
    j = j.withColumn("_pay", F.when(get("payText").isNotNull(), best_pay(or_empty(get("payText")))))
    paid = F.col("_pay.pay_min").isNotNull()
    pay_cols = ["pay_raw", "pay_min", "pay_max", "pay_period", "pay_currency", "pay_min_annual", "pay_max_annual"]
    fills: dict[str, Column] = {c: F.coalesce(get(k), F.col(c)) for k, c in COLUMN_OF.items()}
    fills |= {c: F.when(paid, F.col(f"_pay.{c}")).otherwise(F.col(c)) for c in pay_cols}
    fills["pay_source"] = F.when(paid, "model").otherwise(F.col("pay_source"))
    marks = F.array(*[
        F.when(get(k).isNotNull(), F.struct(F.lit("applyType" if k == "applyRoute" else k).alias("key"),
                                            F.col("_model").alias("value"))) for k in COLUMN_OF],
        F.when(paid, F.struct(F.lit("pay").alias("key"), F.col("_model").alias("value"))))
    none = F.create_map().cast("map<string,string>")
    before = F.coalesce("ai_fields", none)
    new = F.map_from_entries(F.array_compact(marks))
    kept = F.map_filter(before, lambda k, _: ~F.map_contains_key(new, k))
    fills["ai_fields"] = F.when(F.size(new) > 0, F.map_concat(kept, new)).otherwise(F.col("ai_fields"))
    return j.select(*[fills[c].alias(c) if c in fills else F.col(c) for c in postings.columns])


def reply_reason(status: Column, error: Column, usable: Column) -> Column:
    """Why a reply does not count, or null when it does."""
    return (
        F.when(status == 401, "the API key was rejected (401)")
        .when(status == 402, "the account cannot pay for this model (402)")
        .when(status == 429, "rate limited (429)")
        .when(status == 404, "no such model (404)")
        .when(status != 200, F.concat(F.lit("returned "), status.cast("string")))
        .when(or_empty(error) != "", error)
        .when(~F.coalesce(usable, F.lit(False)), "the reply could not be used"))


def first_usable_reply(replies: DataFrame) -> DataFrame:
    """Per request: models in listed order, the first acceptable reply wins, a rejected key ends the walk.

    ``replies(request_id, model_rank, model, status, error, text, usable)``. Two partial aggregations; the
    reasons list holds one entry per configured model.
    """
    why = reply_reason(F.col("status"), F.col("error"), F.col("usable"))
    r = replies.withColumn("why", why)
    # A model is listed once per request: repeated rows collapse to one before any list is built.
    one = r.groupBy("request_id", "model_rank").agg(
        F.min_by(F.struct("model", "text", "why", "status"), F.coalesce("why", F.lit(""))).alias("_r")
    ).select("request_id", "model_rank", "_r.*")
    per = one.groupBy("request_id").agg(
        F.min(F.when(F.col("status") == 401, F.col("model_rank"))).alias("_stop"),
        F.min(F.when(F.col("why").isNull(), F.col("model_rank"))).alias("_ok"),
        F.min_by(F.struct("model", "text"), F.when(F.col("why").isNull(), F.col("model_rank"))).alias("_win"),
        F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("model_rank", "model", "why")))).alias("_bad"),
    )
    won = F.col("_ok").isNotNull() & (F.col("_stop").isNull() | (F.col("_ok") < F.col("_stop")))
    cut = F.coalesce(F.when(won, F.col("_ok")), F.col("_stop"), F.lit(2**31 - 1))
    tried = F.filter("_bad", lambda b: b["model_rank"] <= cut)
    told = F.array_join(F.transform(tried, lambda b: F.concat(b["model"], F.lit(" ("), b["why"], F.lit(")"))), "; ")
    stop_why = F.element_at(tried, -1)["why"]
    return per.select(
        "request_id", won.alias("ok"),
        F.when(won, F.col("_win.model")).alias("model"), F.when(won, F.col("_win.text")).alias("text"),
        F.size(tried).alias("n_tried"),
        F.when(won, F.lit(None)).when(F.col("_stop").isNotNull(), stop_why).otherwise(
            F.concat(F.lit("every configured model failed: "), told)).alias("error_why"))


def call_budget(asks: DataFrame, n: int = CALLS_PER_RUN, run: str = "run_id", order: str = "seq") -> DataFrame:
    """The asks that are made: at most ``n`` per run, none after the run's first rate limit.

    ``rank <= n`` is pushed below the shuffle as a group limit, so a run holding a third of all asks
    sends at most ``n`` rows per input partition.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(run).orderBy(order)
    top = asks.withColumn("call_no", F.row_number().over(w)).where(F.col("call_no") <= n)
    limited = top.withColumn("_hit", F.min(F.when(F.col("rate_limited"), F.col("call_no"))).over(Window.partitionBy(run)))
    return limited.where(F.col("_hit").isNull() | (F.col("call_no") <= F.col("_hit"))).drop("_hit")


def latest_plan(plans: DataFrame) -> DataFrame:
    """The newest plan per path."""
    return plans.groupBy("path").agg(F.max_by(F.struct("plan", "notes", "model", "at"), "at").alias("_p")).select(
        "path", "_p.*")


def known_fields() -> Sequence[str]:
    return tuple(FIELDS)
