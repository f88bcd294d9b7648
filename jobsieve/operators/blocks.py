"""Structure of HTML pages, found without class names.

Everything that concerns one page is array work inside that page's row: elements carry document-order
numbers, so "inside", "above" and "next to" are comparisons and no page ever has to be shuffled. The
operators that really group (repeated shapes, rule checks, changes over time) explode the few elements
they need and use ordinary aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions import header as H
from jobsieve.functions.elements import parse_html
from jobsieve.functions.htmltext import tidy_lines
from jobsieve.functions.regex import rx
from jobsieve.functions.spans import running_sums
from jobsieve.functions.text import let, or_empty

# ---- Fixed values: bounds and labels used to recognise page parts ----
NOT_A_JOB_LINK = "/(in|company|school|groups|events|posts|feed|learning)/"
DESCRIPTION_LABELS = [
    "(?i)^about the job$", "(?i)^about this job$", "(?i)^about the role$", "(?i)^job description$",
    "(?i)^role description$", "(?i)^description$",
]
LABEL_TIERS = [
    ('h2 "About the job"', "(?i)^about the job$"),
    ("heading, about-the-job family", rx("^about (?:the|this) (?:job|role|position){B}", True)),
    ("heading, job-description", "(?i)^(?:job|role|position) description$"),
    ("heading, description", "(?i)^description$"),
]
AGE_LINE = rx(r"\d+{S}*(?:minute|min|hour|hr|day|week|month|year)s?{S}+ago", True)
GROUP_PARENTS = ("div", "section", "main", "ol", "ul")
DENSE_TAGS = ("div", "section", "article", "main")
PILL_TAGS = ("span", "div", "li", "button", "a", "dd", "td")
META_TAGS = ("div", "span", "p", "li", "ul", "section")
# ---- end of fixed values ----


# ---- reading pages ----

def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``raw``, ``rendered``, ``els`` (elements, with the job id each names) and ``links``."""
    keep = [c for c in pages.columns if c != html]
    parsed = pages.select(*keep, parse_html(html).alias("_page")).select(*keep, "_page.*")
    return parsed.withColumn("links", F.filter("els", lambda e: e["is_link"]))


def _counts_upto(els: Column, cond) -> Column:
    """For every element, how many elements up to it, itself included, meet ``cond``: what lies below an element is a difference."""
    return let(F.transform(els, lambda e: F.coalesce(cond(e), F.lit(False)).cast("int")), running_sums)


def block_rows(parsed: DataFrame) -> DataFrame:
    """One row per element."""
    keep = [c for c in parsed.columns if c not in ("raw", "rendered", "els", "links")]
    return parsed.select(*keep, F.inline_outer("els")).where("ord is not null")


def _attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def _inside(inner: Column, outer: Column) -> Column:
    """``inner`` is ``outer`` or below it."""
    return (inner["ord"] >= outer["ord"]) & (inner["ord"] <= outer["last"])


def _below(inner: Column, outer: Column) -> Column:
    return (inner["ord"] > outer["ord"]) & (inner["ord"] <= outer["last"])


def _inner(els: Column, outer: Column) -> Column:
    """The elements below ``outer``: in page order they follow it directly. Null for a null ``outer``."""
    return F.slice(els, outer["ord"] + 2, outer["last"] - outer["ord"])


def _overlap(a: Column, b: Column) -> Column:
    return F.coalesce(_inside(a, b) | _inside(b, a), F.lit(False))


def _in_list(e: Column, root: Column) -> Column:
    return F.coalesce(_inside(e, root), F.lit(False))


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def _first_match(els: Column, cond) -> Column:
    return _first(F.filter(els, cond))


def _first_result(arr: Column, fn) -> Column:
    """First non-null ``fn(x)`` in order."""
    return _first(F.filter(F.transform(arr, fn), lambda x: x.isNotNull()))


def _climb(els: Column, e: Column, levels: int | Column) -> Column:
    """Numbers of the ancestors of ``e``, nearest first, followed parent by parent."""
    n = F.lit(levels) if isinstance(levels, int) else levels
    start = F.struct(e["parent"].alias("at"), F.array().cast("array<int>").alias("out"))
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start,
        lambda acc, _: F.when(acc["at"].isNull(), acc).otherwise(F.struct(
            F.get(els, acc["at"])["parent"].alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))),
        lambda acc: acc["out"]))


def _ancestors(els: Column, e: Column, up_to: int | Column) -> Column:
    """Ancestors of ``e``, nearest first, at most ``up_to`` levels up, page root excluded."""
    return F.filter(F.transform(_climb(els, e, up_to), lambda o: F.get(els, o)), lambda a: ~a["tag"].isin("html", "body"))


def rendered_text(e: Column, rendered: Column | str = "rendered") -> Column:
    """Readable text of an element, from its slice of the page's rendered text."""
    cut = F.substring(F.col(rendered) if isinstance(rendered, str) else rendered,
                      e["out_start"] + 1, e["out_end"] - e["out_start"])
    return tidy_lines(cut)


def raw_text(e: Column) -> Column:
    cut = F.substring(F.col("raw"), e["raw_start"] + 1, e["raw_end"] - e["raw_start"])
    return F.trim(F.regexp_replace(cut, rx("{S}+"), " "))


# ---- the results list ----

def job_links(parsed: DataFrame) -> DataFrame:
    """One row per element that names a posting."""
    keep = [c for c in parsed.columns if c not in ("raw", "rendered", "els", "links")]
    slim = F.transform("links", lambda k: F.struct(
        *[k[c].alias(c) for c in ("ord", "parent", "depth", "tag", "job_id")], F.coalesce(k["text"], raw_text(k)).alias("text")))
    return parsed.select(*keep, F.inline_outer(slim)).where("ord is not null")


def discovery_breakdown(parsed: DataFrame) -> DataFrame:
    """How many elements each id pattern finds."""
    el = parsed.select(F.explode_outer(F.transform("links", lambda k: F.struct(k["tag"].alias("tag"), k["attrs"].alias("attrs")))).alias("e"))
    e = F.col("e")
    href = or_empty(_attr(e, "href"))
    pats = {
        'a[href*="/jobs/view/"]': (e["tag"] == "a") & F.contains(href, F.lit("/jobs/view/")),
        'a[href*="currentJobId="]': (e["tag"] == "a") & F.contains(href, F.lit("currentJobId=")),
        'a[href*="jobId="]': (e["tag"] == "a") & F.contains(href, F.lit("jobId=")),
        **{f"[{n}]": _attr(e, n).isNotNull() for n in H.ID_ATTRS},
        **{f'[{n}*="jobPosting"]': F.contains(or_empty(_attr(e, n)), F.lit("jobPosting")) for n in H.URN_ATTRS},
    }
    one = el.where("e is not null").agg(*[F.count_if(c).alias(f"p{i}") for i, c in enumerate(pats.values())])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("pattern"), F.col(f"p{i}").alias("n")) for i, k in enumerate(pats)])))


def _list_root(els: Column, links: Column) -> Column:
    """The element with the most job links below it (ten levels at most, as the reader counts them), tightest on a tie."""
    able = F.filter(els, lambda e: (e["n_near"] > 0) & (e["tag"] != "html"))
    slim = F.transform(able, lambda e: F.struct(e["n_near"].alias("n"), e["ord"].alias("at"), e["last"].alias("last")))

    def step(best, e):
        # In page order: a later one wins with more links, or with as many if it lies inside.
        return F.when((e["n"] > best["n"]) | ((e["n"] == best["n"]) & (e["at"] <= best["last"])), e).otherwise(best)

    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit(-1).alias("last"))
    best = F.when(F.size(links) >= 2, F.aggregate(slim, zero, step, lambda e: e["at"]))
    return F.get(els, F.when(best >= 0, best))


def list_root(parsed: DataFrame) -> DataFrame:
    """Add ``root``: the results list, or null."""
    return parsed.withColumn("root", _list_root(F.col("els"), F.col("links")))


def _shape(e: Column, cap: int) -> Column:
    return F.concat(F.upper(e["tag"]), F.lit(":"), F.least(F.lit(cap), e["n_children"]))


def _can_hold(up: Column, least: int, most: int) -> Column:
    return up["n_children"].between(least, most) & (up["tag"].isin(*GROUP_PARENTS) | _attr(up, "role").isNotNull())


def _sibling_groups(els: Column, kid_ok, least: int, most: int, cap: int, members: int, non_job=None) -> Column:
    """Same-shaped siblings of one page as ``array<struct<members,depth,neg_first,parent,shape,chars,non_job>>``."""

    def slim(e):
        up = F.get(els, e["parent"])
        return F.struct(
            e["parent"].alias("parent"), _shape(e, cap).alias("shape"), e["ord"].alias("ord"),
            up["depth"].alias("depth"), e["norm_len"].alias("chars"),
            (non_job(e) if non_job else F.lit(False)).alias("non_job"))

    def runs(ks):
        # Sorted, the members of a group are a run; its sums are differences of running sums.
        last = lambda i: F.get(ks, i - 1)
        new = lambda k, i: (i == 0) | (last(i)["parent"] != k["parent"]) | (last(i)["shape"] != k["shape"])
        starts = F.filter(F.transform(ks, lambda k, i: F.when(new(k, i), i)), lambda i: i.isNotNull())
        sums = lambda value: let(F.transform(ks, value), running_sums)
        between = lambda upto, at, end: F.get(upto, end - 1) - F.coalesce(F.get(upto, at - 1), F.lit(0))

        def group(at, end, chars, others):
            k = F.get(ks, at)
            return F.struct((end - at).alias("members"), k["depth"].alias("depth"), (-k["ord"]).alias("neg_first"), k["parent"].alias("parent"),
                            k["shape"].alias("shape"), between(chars, at, end).alias("chars"), between(others, at, end).alias("non_job"))

        found = lambda chars, others: let(starts, lambda at: F.transform(
            at, lambda a, i: group(a, F.coalesce(F.get(at, i + 1), F.size(ks)), chars, others)))
        groups = let(sums(lambda k: k["chars"].cast("bigint")), lambda chars: let(sums(lambda k: k["non_job"].cast("int")), lambda others: found(chars, others)))
        return F.filter(groups, lambda g: g["members"] >= members)

    able = F.filter(els, lambda e: e["parent"].isNotNull() & kid_ok(e) & _can_hold(F.get(els, e["parent"]), least, most))
    return let(F.sort_array(F.transform(able, slim)), runs)


def _card_groups(els: Column) -> Column:
    """Groups that look like result cards: three or more composite siblings with card-sized text."""

    is_anchor = lambda k: (k["tag"] == "a") & _attr(k, "href").isNotNull()

    def grouped_with(anchors, upto):
        def non_job(e):
            link = F.get(anchors, F.get(upto, e["ord"]))  # the first anchor after the element's start
            away = link["job_id"].isNull() & or_empty(_attr(link, "href")).rlike(NOT_A_JOB_LINK)
            return F.coalesce(_below(link, e) & away, F.lit(False))

        return _sibling_groups(els, lambda e: e["text_len"].between(40, 1200) & (e["n_children"] >= 1), 3, 60, 8, 3, non_job)

    return let(F.filter(els, is_anchor), lambda anchors: let(_counts_upto(els, is_anchor), lambda upto: grouped_with(anchors, upto)))


def repeated_groups(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Runs of same-shaped siblings with card-like text: parent, shape, members, share of non-job links.

    Counted inside the page's row, so nothing is shuffled.
    """
    rows = parsed.select(key, F.explode_outer(_card_groups(F.col("els"))).alias("g")).where("g is not null")
    return rows.select(
        key, "g.parent", "g.shape", F.col("g.members").cast("bigint").alias("members"),
        (-F.col("g.neg_first")).alias("first_ord"), "g.depth", (F.col("g.non_job") / F.col("g.members")).alias("non_job_share"))


def job_list_check(groups: DataFrame) -> DataFrame:
    """A list of people or companies is not a job list: under half may link elsewhere."""
    return groups.where("non_job_share < 0.5")


def best_group(groups: DataFrame, key: str = "page_id") -> DataFrame:
    """Most members first, the tightest container on a tie."""
    return groups.groupBy(key).agg(
        F.max_by(F.struct("parent", "shape", "members"), F.struct("members", "depth", -F.col("first_ord"))).alias("_g")
    ).select(key, "_g.*")


def _one_per_id(ks: Column) -> Column:
    """The first of each job id, in order: sorted by id and place, the first of every run."""
    placed = F.sort_array(F.filter(F.transform(ks, lambda k, i: F.struct(k["job_id"].alias("id"), i.alias("at"))), lambda p: p["id"].isNotNull()))
    firsts = let(placed, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (F.get(ps, i - 1)["id"] != p["id"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda p: p["at"])), lambda at: F.get(ks, at))


def with_cards(parsed: DataFrame) -> DataFrame:
    """Pages with their posting ``cards``: by the ids on the page, or by repeated shape when ids give fewer than three.

    Both routes are array work in the page's row: one parse, no join, no shuffle.
    """
    rooted = parsed if "root" in parsed.columns else list_root(parsed)
    els = F.col("els")
    scoped = F.filter("links", lambda k: _below(k, F.col("root")))
    enough = F.coalesce(F.size(scoped) >= F.greatest(F.lit(2.0), F.size("links") * 0.5), F.lit(False))
    use = F.when(enough, scoped).otherwise(F.col("links"))

    def holder(k):
        chain = F.concat(F.array(k["ord"]), _climb(els, k, k["depth"]))
        li = _first(F.filter(chain, lambda o: F.get(els, o)["tag"] == "li"))
        data = _first(F.filter(chain, lambda o: _attr(F.get(els, o), "data-job-id").isNotNull()))
        return F.struct(k["job_id"].alias("job_id"), k["ord"].alias("link_ord"),
                        F.coalesce(li, data, k["parent"], k["ord"]).alias("card_ord"))

    def members_of(g):
        mine = F.filter(els, lambda c: (c["parent"] == g["parent"]) & (_shape(c, 8) == g["shape"])
                        & c["text_len"].between(40, 1200) & (c["n_children"] >= 1))
        return F.transform(mine, lambda c: F.struct(
            c["job_id"].alias("job_id"), F.lit(None).cast("int").alias("link_ord"), c["ord"].alias("card_ord")))

    on_jobs = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).rlike("^/jobs(/|$)")
    by_id = rooted.withColumn("_by_id", F.transform(let(use, _one_per_id), holder))
    job_groups = F.filter(_card_groups(els), lambda g: g["non_job"] * 2 < g["members"])
    shaped = by_id.withColumn("_group", F.when((F.size("_by_id") < 3) & on_jobs, F.array_max(job_groups)))
    chosen = shaped.withColumn("_by_shape", F.when(F.col("_group").isNotNull(), members_of(F.col("_group"))))
    c = F.when(F.size("_by_shape") > F.size("_by_id"), F.col("_by_shape")).otherwise(F.col("_by_id"))
    return chosen.withColumn("cards", c).drop("_by_id", "_by_shape", "_group")


def cards(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per posting card."""
    found = with_cards(parsed).select(key, F.posexplode_outer("cards").alias("card_no", "c"))
    return found.where("c is not null").select(key, "card_no", "c.*")


def keyed_cards(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Cards of the layout that carries the posting id in each card's component key, once per id."""
    buttons = F.filter("els", lambda e: (or_empty(_attr(e, "role")) == "button") & H.card_key(e["attrs"]).isNotNull())
    found = F.transform(buttons, lambda e: F.struct(H.card_key(e["attrs"]).alias("job_id"), e["ord"].alias("card_ord")))
    rows = parsed.select(key, F.posexplode_outer(let(found, _one_per_id)).alias("card_no", "c")).where("c is not null")
    return rows.select(key, "card_no", "c.*")


# ---- the description ----

def _plausible(e: Column, root: Column) -> Column:
    return F.coalesce(
        (e["text_len"] >= 200) & ~_overlap(e, root) & ~e["in_chrome"] & (e["n_links"] < 2), F.lit(False))


def plausible_descriptions(parsed: DataFrame) -> DataFrame:
    """Element numbers that could be a description."""
    rooted = parsed if "root" in parsed.columns else list_root(parsed)
    ok = F.filter("els", lambda e: _plausible(e, F.col("root")))
    return rooted.withColumn("plausible", F.transform(ok, lambda e: e["ord"]))


def _is_heading(e: Column) -> Column:
    return e["tag"].rlike("^h[1-6]$") | (or_empty(_attr(e, "role")) == "heading")


def _label_of(e: Column) -> Column:
    return F.when(_is_heading(e), e["text"]).when(e["tag"].isin("div", "span"), e["own_text"])


def _heading_description(els: Column, root: Column) -> Column:
    """The block after (or around) the first description label that has real content next to it."""

    def is_label(e):
        label = _label_of(e)
        hit = reduce(lambda a, b: a | b, [label.rlike(p) for p in DESCRIPTION_LABELS])
        return F.coalesce((F.length(label) <= 40) & hit & ~_in_list(e, root), F.lit(False))

    def content(h):
        nxt = _first_match(els, lambda s: (s["parent"] == h["parent"]) & (s["ord"] > h["ord"]) & (s["text_len"] >= 200))
        up = F.get(els, h["parent"])
        return F.coalesce(nxt, F.when(up["text_len"] >= 200, up))

    return _first_result(F.filter(els, is_label), content)


def _dense_block(els: Column, root: Column) -> Column:
    """The deepest block holding nearly all of the most text outside the list."""
    able = F.filter(els, lambda e: e["tag"].isin(*DENSE_TAGS) & (e["text_len"] >= 400)
                    & ~_overlap(e, root) & (e["n_links"] < 2))

    def tighten(cs):
        top = F.array_max(F.transform(cs, lambda c: c["text_len"]))
        dense = F.filter(cs, lambda c: c["text_len"] >= top * 0.85)
        return F.get(els, F.aggregate(
            F.transform(dense, lambda c: F.struct(c["ord"].alias("ord"), c["last"].alias("last"))),
            F.struct(F.lit(-1).alias("ord"), F.lit(2**31 - 1).alias("last")),
            lambda best, c: F.when(_inside(c, best), c).otherwise(best),
        )["ord"])

    return F.when(F.size(able) > 0, let(able, tighten))


def description_of_page(parsed: DataFrame) -> DataFrame:
    """Add ``root``, ``desc`` (element or null), ``desc_via`` and ``description`` (readable text)."""
    rooted = parsed if "root" in parsed.columns else list_root(parsed)
    els, root = F.col("els"), F.col("root")
    staged = rooted.withColumn("_h", _heading_description(els, root)).withColumn("_d", _dense_block(els, root))
    ok_h, ok_d = _plausible(F.col("_h"), root), _plausible(F.col("_d"), root)
    out = staged.withColumn("desc", F.when(ok_h, F.col("_h")).when(ok_d, F.col("_d"))).withColumn(
        "desc_via", F.when(ok_h, "heading").when(ok_d, "dense")).drop("_h", "_d")
    return out.withColumn("description", F.coalesce(rendered_text(F.col("desc")), F.lit("")))


def _bulk_block(els: Column, root: Column, pane: Column, link: Column) -> Column:
    """Largest plausible block of the pane without the header link, tightened up to four levels."""
    able = F.filter(els, lambda e: e["tag"].isin("div", "section", "article") & _below(e, pane)
                    & ~F.coalesce(_inside(link, e), F.lit(False)) & _plausible(e, root))

    def down(cs):
        top = F.array_max(F.transform(cs, lambda c: F.struct(c["norm_len"].alias("n"), (-c["ord"]).alias("o"))))

        def step(cur, _):
            kid = _first_match(els, lambda k: (k["parent"] == cur) & (k["norm_len"] >= top["n"] * 0.9))
            return F.coalesce(kid["ord"], cur)

        at = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), -top["o"], step)
        return F.when(top["n"] >= 100, F.get(els, at))

    return let(able, down)


def selected_link(parsed: DataFrame) -> DataFrame:
    """Add ``link``: the first posting link on the page, which names the posting being shown."""
    return parsed.withColumn("link", _first_match(F.col("els"), lambda e: (e["tag"] == "a") & F.contains(
        or_empty(_attr(e, "href")), F.lit("/jobs/view/")) & e["job_id"].isNotNull()))


def heading_description_wide(parsed: DataFrame) -> DataFrame:
    """Add ``wide`` and ``wide_via``: tiered heading search, then siblings, ancestors, then sheer bulk."""
    linked = parsed if "link" in parsed.columns else selected_link(parsed)
    linked = linked if "root" in linked.columns else list_root(linked)
    els, root, link = (F.col(c) for c in ("els", "root", "link"))
    heads = F.filter(els, lambda e: e["tag"].isin("h1", "h2", "h3", "h4") | (or_empty(_attr(e, "role")) == "heading"))

    def tier(pattern):
        return _first_match(F.col("_heads"), lambda h: F.coalesce(
            (h["norm_len"] <= 60) & h["text"].rlike(pattern), F.lit(False)))

    tiers = [tier(p) for _, p in LABEL_TIERS]
    staged = linked.withColumn("_heads", heads)
    for i, t in enumerate(tiers):
        staged = staged.withColumn(f"_t{i}", t)
    names = [f"_t{i}" for i in range(len(tiers))]
    via = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(v)) for n, (v, _) in zip(names, LABEL_TIERS)])
    staged = staged.withColumn("_head", F.coalesce(*names)).withColumn("_via", via)
    h = F.col("_head")
    sib = _first_match(els, lambda s: (s["parent"] == h["parent"]) & (s["ord"] > h["ord"]) & (s["norm_len"] >= 100))
    above = _ancestors(els, h, 4)
    up = _first(F.filter(above, lambda a: ~F.coalesce(_inside(root, a), F.lit(False))
                         & (a["norm_len"] - h["norm_len"] >= 100)))
    staged = staged.withColumn("_sib", F.when(h.isNotNull(), sib)).withColumn("_up", F.when(h.isNotNull(), up))
    staged = staged.withColumn("_pane", _pane_of_link(els, root, link, h)).withColumn(
        "_bulk", F.when(F.col("_sib").isNull() & F.col("_up").isNull() & F.col("_pane").isNotNull(),
                        _bulk_block(els, root, F.col("_pane"), link)))
    level = (h["depth"] - F.col("_up.depth")).cast("string")
    out = staged.withColumn("wide", F.coalesce("_sib", "_up", "_bulk")).withColumn(
        "wide_via",
        F.when(F.col("_sib").isNotNull(), F.concat("_via", F.lit(", sibling")))
        .when(F.col("_up").isNotNull(), F.concat("_via", F.lit(", ancestor +"), level))
        .when(F.col("_bulk").isNotNull(), "largest block in the pane (no heading)"))
    return out.drop("_heads", *names, "_head", "_via", "_sib", "_up", "_bulk").withColumnRenamed("_pane", "link_pane")


def _pane_of_link(els: Column, root: Column, link: Column, head: Column) -> Column:
    """Smallest element holding link and heading; without a heading the widest one short of the list."""
    ok = F.filter(_ancestors(els, link, 12), lambda a: ~F.coalesce(_inside(root, a), F.lit(False)))
    both = _first(F.filter(ok, lambda a: F.coalesce(_inside(head, a), F.lit(False))))
    return F.when(link.isNotNull(), F.coalesce(both, F.element_at(F.concat(F.array(F.get(els, link["parent"])), ok), -1)))


def header_region(parsed: DataFrame) -> DataFrame:
    """Add ``region``: widened from the posting link, never reaching the list or the description."""
    base = parsed if "wide" in parsed.columns else heading_description_wide(parsed)
    els, link = F.col("els"), F.col("link")
    ups = F.filter(_ancestors(els, link, 8), lambda a: ~F.coalesce(_inside(F.col("root"), a), F.lit(False))
                   & ~F.coalesce(_inside(F.col("wide"), a), F.lit(False)) & (a["norm_len"] <= 2000))
    sized = F.filter(ups, lambda a: a["norm_len"] >= 40)
    region = F.element_at(F.concat(F.array(F.get(els, link["parent"])), sized), -1)
    return base.withColumn("region", F.when(link.isNotNull(), region))


# ---- title, company, pills, meta line, apply control ----

def _pane(els: Column, desc: Column, root: Column) -> Column:
    """Outermost ancestor of the description that holds neither the list nor page chrome."""
    ok = F.filter(_ancestors(els, desc, 14), lambda a: ~F.coalesce(_inside(root, a), F.lit(False)) & ~a["in_chrome"])
    return F.when(desc.isNotNull(), F.element_at(F.concat(F.array(desc), ok), -1))


def _scopes(els: Column, near: Column, pane: Column) -> Column:
    return F.filter(_ancestors(els, near, 12), lambda a: a["depth"] >= F.coalesce(pane["depth"], F.lit(0)))


def _title(els: Column, near: Column, pane: Column, root: Column) -> Column:
    # Every scope is the pane or lies in it.
    heads = F.filter(_inner(els, pane), lambda e: e["tag"].isin("h1", "h2", "h3") | (or_empty(_attr(e, "role")) == "heading"))

    def usable(e):
        return F.coalesce(~e["in_chrome"] & ~_in_list(e, root) & H.looks_like_title(e["text"]), F.lit(False))

    def in_scope(hs):
        def one(s):
            h1 = _first_match(hs, lambda h: (h["tag"] == "h1") & _below(h, s))
            other = _first_match(hs, lambda h: (h["tag"] != "h1") & _below(h, s) & usable(h))
            return F.coalesce(F.when(usable(h1), h1), other)

        return _first_result(_scopes(els, near, pane), one)

    return F.when(near.isNotNull(), let(heads, in_scope))


def _company(els: Column, near: Column, pane: Column, root: Column) -> Column:
    named = F.filter(_inner(els, pane), lambda e: (e["tag"] == "a") & F.contains(or_empty(_attr(e, "href")), F.lit("/company/"))
                     & ~_in_list(e, root) & ~e["in_chrome"] & (H.company_text(e["text"]) != ""))
    return F.when(near.isNotNull(), let(named, lambda cs: _first_result(
        _scopes(els, near, pane), lambda s: _first_match(cs, lambda c: _below(c, s)))))


def _top_card(els: Column, title: Column) -> Column:
    fits = _first(F.filter(_ancestors(els, title, 6), lambda a: (a["text_len"] > 80) & (a["text_len"] < 2000)))
    return F.coalesce(fits, F.get(els, title["parent"]))


def _pills(els: Column, scope: Column, desc: Column, root: Column) -> Column:
    own = F.filter(_inner(els, scope), lambda e: e["tag"].isin(*PILL_TAGS) & ~_in_list(e, desc)
                   & ~_in_list(e, root) & ~e["in_chrome"] & (e["own_text"] != "") & (F.length(e["own_text"]) <= 40))
    none = F.array().cast("array<string>")
    return F.when(scope.isNotNull(), F.array_distinct(F.transform(own, lambda e: e["own_text"]))).otherwise(none)


def _meta_line(els: Column, scope: Column, desc: Column) -> Column:
    """Most middot parts, shortest on a tie, first in the page after that; an age line counts as one part."""
    near = F.filter(_inner(els, scope), lambda e: e["tag"].isin(*META_TAGS) & ~_overlap(e, desc)
                    & ~e["in_chrome"] & e["norm_len"].between(1, 200))

    def rate(e):
        parts = F.size(F.filter(F.split(e["text"], H.MIDDOT), lambda p: p != ""))
        n = F.when(parts > 1, parts).when(e["text"].rlike(AGE_LINE), 1).otherwise(0)
        return F.struct(n.alias("n"), (-e["norm_len"]).alias("short"), (-e["ord"]).alias("early"), e["text"].alias("text"))

    best = F.array_max(F.filter(F.transform(near, rate), lambda r: r["n"] > 0))
    return F.coalesce(best["text"], F.lit(""))


def _apply_control(els: Column, scope: Column, root: Column) -> Column:
    """A short control that says Apply, an explicit Easy Apply first; ``scope`` null means the whole page."""

    def says(e):
        own = F.when(e["norm_len"] <= 40, e["text"]).otherwise("")
        aria = F.trim(F.regexp_replace(or_empty(_attr(e, "aria-label")), rx("{S}+"), " "))
        aria = F.when(F.length(aria) <= 120, aria).otherwise("")
        test = lambda p: own.rlike(p) | aria.rlike(p)
        return F.when(test(rx("^easy apply{B}", True)), 2).when(test(rx("^apply{B}", True)), 1)

    within = F.when(scope.isNull(), els).otherwise(_inner(els, scope))
    able = F.filter(within, lambda e: ((e["tag"] == "button") | ((e["tag"] == "a") & _attr(e, "href").isNotNull())
                                    | (or_empty(_attr(e, "role")) == "button"))
                    & ~_in_list(e, root) & says(e).isNotNull())
    return let(able, lambda cs: F.coalesce(_first_match(cs, lambda c: says(c) == 2), _first(cs)))


def page_parts(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Everything a posting needs from its page, one row per page. No shuffle after the parse."""
    els, root, desc, pane, title = (F.col(c) for c in ("els", "root", "desc", "pane", "title_el"))
    located = (
        description_of_page(parsed)
        .withColumn("pane", _pane(els, desc, root))
        .withColumn("title_el", _title(els, desc, pane, root))
        .withColumn("company_el", _company(els, F.coalesce(title, desc), pane, root))
        .withColumn("top", F.coalesce(_top_card(els, title), pane))
        .withColumn("control", F.coalesce(_apply_control(els, pane, root), _apply_control(els, F.lit(None).cast(
            parsed.schema["els"].dataType.elementType), root)))
        .withColumn("badge", F.exists("els", lambda e: (e["norm_len"] <= 20) & e["text"].rlike("(?i)^easy apply$")
                                      & ~_in_list(e, root)))
    )
    keep = [c for c in parsed.columns if c not in ("raw", "rendered", "els", "links", "root")]
    control = F.col("control")
    return located.select(
        *keep,
        or_empty(title["text"]).alias("title"),
        H.company_text(F.col("company_el.text")).alias("company"),
        or_empty(_attr(F.col("company_el"), "href")).alias("company_url"),
        _meta_line(els, F.col("top"), desc).alias("meta_line"),
        F.coalesce(raw_text(F.col("top")), F.lit("")).alias("top_text"),
        _pills(els, F.col("top"), desc, root).alias("pills"),
        "description", "desc_via",
        F.when(control.isNotNull(), or_empty(control["text"])).when(F.col("badge"), "Easy Apply").alias("apply_text"),
        _attr(control, "aria-label").alias("apply_aria"),
        _attr(control, "href").alias("apply_href"),
    )


# ---- changes, rules, turns ----

def changed_blocks(before: DataFrame, after: DataFrame, key: str = "url") -> DataFrame:
    """Blocks whose text changed while their place stayed, and for each page the smallest block covering them.

    ``before`` and ``after`` are parsed snapshots, one row per page each. They meet in one join of slim rows
    (places and hashes, no text); the comparison itself is array work inside the joined row.
    """
    rooted = after if "root" in after.columns else list_root(after)
    placed = lambda els: F.transform(
        F.filter(els, lambda e: e["text_hash"].isNotNull()), lambda e: F.struct(e["css_path"].alias("css_path"), e["text_hash"].alias("text_hash")))
    slim = F.transform("els", lambda e: F.struct(
        *[e[c].alias(c) for c in ("ord", "last", "tag", "norm_len", "css_path", "text_hash")]))
    was = before.select(key, placed("els").alias("_places"))
    now = rooted.select(key, slim.alias("els"), F.struct("root.ord", "root.last").alias("root"))
    # A page whose places and hashes are all the same ends here, after one comparison.
    met = now.join(was, key).where(placed("els") != F.col("_places")).withColumn("_was", F.map_from_entries("_places"))
    moved = F.filter("els", lambda e: e["text_hash"].isNotNull() & ~_overlap(e, F.col("root"))
                     & F.coalesce(F.try_element_at("_was", e["css_path"]) != e["text_hash"], F.lit(False)))
    found = met.withColumn("changed", moved).where(F.size("changed") > 0)
    # In page order what lies below an element follows it directly: the next changed one decides.
    leaf = F.filter("changed", lambda c, i: F.coalesce(F.get("changed", i + 1)["ord"] > c["last"], F.lit(True)))
    covered = found.withColumn("leaves", leaf).withColumn("_c", _cover(F.col("els"), F.col("root"), F.col("leaves")))
    return covered.select(
        key, F.size("changed").alias("n_changed"), F.size("leaves").alias("n_leaves"), F.col("_c.ord").alias("block_ord"),
        F.col("_c.css_path").alias("css_path"), F.col("_c.norm_len").alias("norm_len"))


def moved_blocks(before: DataFrame, after: DataFrame, key: str = "url") -> DataFrame:
    """Blocks that kept their text and changed their place: the outermost ones, with the place they had (``from_path``) and have.

    A block is found again by its page and text. Elements that only wrap a block count with it as one, the outermost; a text that
    stands at several places of either snapshot is left out, as nothing says which went where. Pages without a key and
    pages of one snapshot only give no rows. Rows carry places and hashes, no text; both sides meet on the keys they were counted by.
    """

    def once(parsed: DataFrame) -> DataFrame:
        slim = F.transform(F.filter("els", lambda e: e["text_hash"].isNotNull()), lambda e: F.struct(
            *[e[c].alias(c) for c in ("ord", "last", "tag", "css_path", "text_hash")]))
        rows = parsed.where(F.col(key).isNotNull()).select(key, F.inline(slim))
        kept = _outermost(rows, key, "text_hash")
        return kept.groupBy(key, "text_hash").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("ord", "last", "tag", "css_path")]).where("n = 1")

    was = once(before).select(key, "text_hash", F.col("css_path").alias("from_path"))
    found = once(after).join(was, [key, "text_hash"]).where("css_path <> from_path")
    return _outermost(found, key).select(key, F.col("ord").alias("block_ord"), "tag", "from_path", "css_path")


def _outermost(rows: DataFrame, *by: str) -> DataFrame:
    """Elements that lie in no other element of their group; elements nest, so the widest reach before one decides."""
    earlier = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max("last").over(earlier)).where("_reach is null or _reach < ord").drop("_reach")


def _cover(els: Column, root: Column, leaves: Column) -> Column:
    """The one changed leaf, else the tightest element around all of them, else the largest leaf."""
    lo = F.array_min(F.transform(leaves, lambda x: x["ord"]))
    hi = F.array_max(F.transform(leaves, lambda x: x["last"]))
    around = F.array_max(F.transform(
        F.filter(els, lambda e: (e["ord"] <= lo) & (e["last"] >= hi) & ~e["tag"].isin("html", "body")
                 & ~F.coalesce(_inside(root, e), F.lit(False))), lambda e: e["ord"]))
    largest = -F.array_max(F.transform(leaves, lambda x: F.struct(
        x["norm_len"].alias("n"), (-x["ord"]).alias("o"))))["o"]
    return F.when(F.size(leaves) == 1, F.get(els, _first(leaves)["ord"])).otherwise(
        F.get(els, F.coalesce(around, largest)))


def static_blocks(parsed: DataFrame, host: Column | None = None) -> DataFrame:
    """Per host and place: how often the place holds text and how many different texts it held."""
    h = host if host is not None else H.host_of("url")
    slim = F.transform(F.filter("els", lambda e: e["text_hash"].isNotNull()), lambda e: F.struct(
        e["css_path"].alias("css_path"), e["text_hash"].alias("text_hash")))
    rows = parsed.select(h.alias("host"), F.inline_outer(slim)).where("text_hash is not null")
    # Two steps, each combined before its shuffle: the count is exact and no task holds a host's texts.
    texts = rows.groupBy("host", "css_path", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("host", "css_path").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("texts"))


def turn_groups(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Likely conversation turns: two or more same-shaped siblings of at least twenty characters."""
    groups = _sibling_groups(F.col("els"), lambda e: e["text_len"] >= 20, 2, 400, 6, 2)
    rows = parsed.select(key, F.explode_outer(groups).alias("g")).where("g is not null")
    return rows.select(key, "g.parent", "g.shape", F.col("g.members").cast("bigint").alias("members"),
                       (-F.col("g.neg_first")).alias("first_ord"), "g.chars")
