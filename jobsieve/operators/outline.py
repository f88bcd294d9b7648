"""A compact outline of a page, and checking extraction rules against its elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.header import host_of
from jobsieve.functions.regex import rx
from jobsieve.functions.text import or_empty
from jobsieve.operators.blocks import _attr, _inside, description_of_page, list_root, with_cards

# ---- Fixed values: outline limits, noted attributes, and what each extraction rule must satisfy ----
MAX_OUTLINE, MAX_DEPTH, MAX_TEXT, MAX_ATTR, MAX_INDENT = 16_000, 16, 60, 48, 12
SKIPPED = ("script", "style", "noscript", "template", "svg", "path", "canvas", "link", "meta", "img", "picture",
           "source", "video", "iframe")
NOTED = ("role", "aria-label", "aria-expanded", "type", "data-job-id", "data-occludable-job-id", "data-jobid",
         "data-view-name", "data-test-id", "data-testid", "data-live-test-id")
RULES = {
    "list": {"min": 1, "min_children": 3},
    "card": {"min": 3},
    "cardLink": {"min": 3},
    "title": {"min": 1, "min_text": 2, "max_text": 160},
    "company": {"min": 1, "min_text": 1, "max_text": 120},
    "description": {"min": 1, "min_text": 200, "outside_list": True},
    "showMore": {"min": 1, "max_text": 40, "label": "(?i)(?:more|expand|show|see)"},
    "pills": {"min": 1, "max_text": 60},
    "applyButton": {"min": 1, "max_text": 40, "label": "(?i)apply"},
    "nextPage": {"min": 1, "max_text": 40, "label": rx(r"(?:next|forward|›|»|→|^{S}*\d+{S}*\z)", True)},
}
BROAD = ("html", "body", "main", "*", ":root")
# ---- end of fixed values ----


def _clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def _short_href(e: Column, url: Column) -> Column:
    raw = or_empty(_attr(e, "href"))
    path = F.regexp_replace(F.regexp_replace(raw, r"(?i)^https?://[^/?#]*", ""), r"[?#].*$", "")
    host = host_of(raw)
    other = F.when(host.isNotNull() & ~host.eqNullSafe(host_of(url)), host).otherwise("")
    job = F.regexp_extract(raw, r"[?&](?:currentJobId|jobId)=([^&#]*)", 1)
    shown = F.concat(other, path, F.when(job != "", F.concat(F.lit("?currentJobId="), job)).otherwise(""))
    return F.when(raw != "", _clip(shown, MAX_ATTR))


def describe(e: Column, url: Column) -> Column:
    """``tag#id.class[attr="x"]  "own text"``."""
    classes = F.slice(F.filter(F.split(or_empty(_attr(e, "class")), rx("{S}+")), lambda c: c != ""), 1, 4)
    noted = [
        F.when(_attr(e, a).isNotNull(), F.concat(
            F.lit("[" + a), F.when(_attr(e, a) != "", F.concat(F.lit('="'), _clip(_attr(e, a), MAX_ATTR), F.lit('"')))
            .otherwise(""), F.lit("]")))
        for a in NOTED
    ]
    own = e["own_text"]
    return F.concat_ws(
        "", e["tag"],
        F.when(or_empty(_attr(e, "id")) != "", F.concat(F.lit("#"), _attr(e, "id"))),
        F.when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(classes, "."))),
        *noted,
        F.concat(F.lit('[href="'), _short_href(e, url), F.lit('"]')),
        F.when(own != "", F.concat(F.lit('  "'), _clip(own, MAX_TEXT), F.lit('"'))),
    )


def _outline(els: Column, url: Column) -> Column:
    """One pass in document order; ``skip`` is the last element of a subtree that is left out."""
    top = F.coalesce(
        F.get(F.filter(els, lambda e: e["tag"] == "main"), F.lit(0)),
        F.get(F.filter(els, lambda e: e["tag"] == "body"), F.lit(0)), F.get(els, F.lit(0)))
    start = F.struct(F.lit(-1).alias("skip"), F.lit(0).alias("chars"), F.lit(False).alias("cut"),
                     F.array().cast("array<string>").alias("lines"))

    def indent(depth, text):
        return F.concat(F.repeat(F.lit("  "), F.least(depth, F.lit(MAX_INDENT))), text)

    def step(acc, e):
        depth = e["depth"] - e["top_depth"]
        # "run" tells the first of same-shaped siblings (its length) from the ones it stands for (0).
        line = F.when(e["run"] > 0, indent(depth, e["text"])).when(
            e["more"] > 0, indent(depth, F.concat(F.lit("… ×"), e["more"].cast("string"),
                                                 F.lit(" more siblings of the same shape"))))
        over = acc["chars"] + F.length(line) > MAX_OUTLINE
        emit = line.isNotNull() & (e["drop"] == 0)
        closed = (e["run"] == 0) | (e["drop"] > 0) | (depth >= MAX_DEPTH)
        note = F.concat(F.lit("  … outline truncated at "), F.size(acc["lines"]).cast("string"), F.lit(" lines"))
        return F.when(acc["cut"] | (e["ord"] <= acc["skip"]), acc).otherwise(F.struct(
            F.when(closed, e["last"]).otherwise(acc["skip"]).alias("skip"),
            F.when(emit & ~over, acc["chars"] + F.length(line) + 1).otherwise(acc["chars"]).cast("int").alias("chars"),
            F.coalesce(emit & over, F.lit(False)).alias("cut"),
            F.when(emit & over, F.array_append(acc["lines"], note))
            .when(emit, F.array_append(acc["lines"], line)).otherwise(acc["lines"]).alias("lines"),
        ))

    def slim(e):
        return F.struct(
            e["ord"].alias("ord"), e["last"].alias("last"), e["depth"].alias("depth"), e["run"].alias("run"),
            top["depth"].alias("top_depth"), e["more"].alias("more"),
            (e["tag"].isin(*SKIPPED) | e["hidden"]).cast("int").alias("drop"), describe(e, url).alias("text"))

    scope = F.filter(els, lambda e: _inside(e, top))
    walked = F.aggregate(F.transform(scope, slim), start, step, lambda acc: acc["lines"])
    return F.array_join(walked, "\n")


def page_outline(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, outline``: hidden parts left out, repeated siblings collapsed, at most 16,000 characters."""
    return parsed.select(key, _outline(F.col("els"), F.col("url")).alias("outline"))


def page_digest(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """The outline with a short summary of what structure alone finds on the page."""
    found = description_of_page(with_cards(parsed))
    params = F.array_join(F.regexp_extract_all("url", F.lit("[?&]([^=&#]+)"), F.lit(1)), ", ")
    desc = F.when(F.col("desc").isNotNull(), F.concat(
        F.col("desc.tag"), F.lit(", "), F.col("desc.norm_len").cast("string"), F.lit(" chars"))).otherwise("none")
    ids = F.size(F.array_distinct(F.transform("links", lambda k: k["job_id"])))
    return found.select(key, F.concat_ws(
        "\n",
        F.concat(F.lit("url: "), F.regexp_replace("url", r"[?#].*$", "")),
        F.concat(F.lit("query params: "), F.when(params != "", params).otherwise("(none)")),
        F.lit(""),
        F.lit("WHAT STRUCTURE ALONE FINDS"),
        F.concat(F.lit("  elements carrying a job id: "), F.size("links").cast("string"), F.lit(" ("),
                 ids.cast("string"), F.lit(" distinct ids)")),
        F.concat(F.lit("  cards: "), F.coalesce(F.size("cards"), F.lit(0)).cast("string")),
        F.concat(F.lit("  description candidate: "), desc),
        F.lit(""),
        F.lit("OUTLINE"),
        _outline(F.col("els"), F.col("url")),
    ).alias("digest"))


def _matches(els: Column, rule: dict) -> Column:
    def hit(e):
        ok = F.lit(True)
        if rule.get("tag"):
            ok = ok & (e["tag"] == rule["tag"])
        if rule.get("cls"):
            ok = ok & F.array_contains(F.split(or_empty(_attr(e, "class")), rx("{S}+")), rule["cls"])
        if rule.get("attr"):
            have = _attr(e, rule["attr"])
            ok = ok & (have.isNotNull() if rule.get("value") is None else have.eqNullSafe(F.lit(rule["value"])))
        return ok

    return F.filter(els, hit)


def _verdict(key: str, rule: dict, els: Column, root: Column) -> Column:
    """``struct<ok,count,why>`` for one rule on one page: the first failing check gives the reason."""
    limits = RULES.get(key)
    if limits is None:
        why, count = F.lit("not a field the collector uses"), F.lit(0)
    elif rule.get("tag") in BROAD and not rule.get("cls") and not rule.get("attr"):
        why, count = F.lit("too broad to mean anything"), F.lit(0)
    else:
        found = _matches(els, rule)
        count, e = F.size(found), F.get(found, F.lit(0))
        n = e["norm_len"]
        least, most = limits.get("min_text"), limits.get("max_text")
        chars = lambda tail: F.concat(F.lit("first match holds "), n.cast("string"), F.lit(tail))
        checks = [
            (count < limits["min"], F.concat(
                F.lit("matched "), count.cast("string"), F.lit(f" element(s), needs {limits['min']}"))),
            (e["tag"].isin("html", "body"), F.lit("resolves to the whole page")),
        ]
        if least:
            checks.append((n < least, chars(f" characters, needs {least}")))
        if most:
            checks.append((n > most, chars(f" characters — too much to be a {key}")))
        if kids := limits.get("min_children"):
            checks.append((e["n_children"] < kids, F.concat(
                F.lit("first match has "), e["n_children"].cast("string"), F.lit(f" children, needs {kids}"))))
        if limits.get("label"):
            label = F.trim(F.concat_ws(" ", or_empty(e["text"]), or_empty(_attr(e, "aria-label"))))
            checks.append((~label.rlike(limits["label"]), F.concat(
                F.lit('nothing about "'), _clip(label, 30), F.lit(f'" says {key}'))))
        if limits.get("outside_list"):
            touches = F.coalesce(_inside(e, root) | _inside(root, e), F.lit(False))
            checks.append((touches, F.lit("overlaps the results list")))
        why = F.coalesce(*[F.when(c, w) for c, w in checks])
    return F.struct(F.lit(key).alias("key"), why.isNull().alias("ok"), count.alias("count"), why.alias("why"))


def rule_audit(parsed: DataFrame, rules: dict[str, dict], key: str = "page_id") -> DataFrame:
    """``key, rule key, ok, count, why`` for every page and rule; a rule is ``{tag, cls, attr, value}``.

    The rules are plan-time constants, so each page checks them inside its own row: no join.
    """
    rooted = parsed if "root" in parsed.columns else list_root(parsed)
    verdicts = F.array(*[_verdict(k, r, F.col("els"), F.col("root")) for k, r in rules.items()])
    return rooted.select(key, F.inline(verdicts)).toDF(key, "rule", "ok", "count", "why")


def audit_summary(audit: DataFrame) -> DataFrame:
    """How often each rule holds, and its most common reason for failing."""
    by_reason = audit.groupBy("rule", "why").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("k"))
    return by_reason.groupBy("rule").agg(
        F.sum("n").alias("pages"), F.sum("k").alias("ok_pages"),
        F.max_by("why", F.when(F.col("why").isNotNull(), F.struct("n", "why"))).alias("top_reason"))


