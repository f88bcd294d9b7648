"""URL filter: explicit host and path rules first, then a tree of path templates per host.

A path is a list of segments. Going down the tree of a host, digit runs are generalised in every segment; where a node has
very many children the rare ones become one wildcard; and siblings whose labelled rates do not differ significantly become
one branch. Each node's blocked rate is smoothed towards its parent's, up to the rate of all labelled URLs; a URL is blocked
if its template's rate reaches the threshold. Only aggregates per template go through the tree, never URLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.store import stored

MAX_DEPTH = 8  # what lies deeper is one last segment
MAX_CHILDREN = 16
KEEP_SHARE = 0.05  # a child with this share of a crowded node stays itself
Z = 1.96
SMOOTHING = 5.0
THRESHOLD = 0.5
WILD = "*"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` of ``(verdict, rule)`` that fits the host or a domain above it and the path's beginning."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def segments(path: Column, depth: int = MAX_DEPTH) -> Column:
    """Segments after the first slash with digit runs generalised; those past ``depth`` are joined into the last."""
    parts = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    deep = F.concat(F.slice(parts, 1, depth - 1), F.array(F.array_join(F.slice(parts, depth, F.size(parts)), "/")))
    return F.when(F.size(parts) > depth, deep).otherwise(parts)


def _merged(siblings: Column) -> Column:
    """Groups of ``(rate, seg, labelled, blocked)`` structs, in order of rate, whose neighbours a two-sided test of two
    proportions does not tell apart. A branch without labels stays by itself."""
    start = F.array().cast("array<struct<segs:array<string>,labelled:bigint,blocked:bigint>>")

    def join(groups: Column, s: Column) -> Column:
        last = F.element_at(groups, -1)
        n1, n2 = last["labelled"], s["labelled"]
        pooled = (last["blocked"] + s["blocked"]) / F.nullif(n1 + n2, F.lit(0))
        apart = F.abs(last["blocked"] / F.nullif(n1, F.lit(0)) - s["blocked"] / F.nullif(n2, F.lit(0)))
        same = apart <= F.lit(Z) * F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n2, F.lit(0))))
        whole = F.struct(F.array_append(last["segs"], s["seg"]).alias("segs"), (n1 + n2).alias("labelled"), (last["blocked"] + s["blocked"]).alias("blocked"))
        alone = F.struct(F.array(s["seg"]).alias("segs"), n2.alias("labelled"), s["blocked"].alias("blocked"))
        grown = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(whole))
        return F.when((F.size(groups) > 0) & F.coalesce(same, F.lit(False)), grown).otherwise(F.concat(groups, F.array(alone)))

    return F.aggregate(siblings, start, join)


def template_tree(urls: DataFrame, max_depth: int = MAX_DEPTH, max_children: int = MAX_CHILDREN, keep_share: float = KEEP_SHARE,
                  smoothing: float = SMOOTHING) -> DataFrame:
    """``(host, segs, template, rate)`` for every host and list of segments in ``urls(host, segs, blocked)``, where ``blocked``
    is null for unlabelled rows."""
    sums = (F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    leaves = stored(urls.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"),
                                                     F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("blocked")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"),
                       F.coalesce(F.max(F.size("segs")), F.lit(0)).alias("depth")).first()
    overall = (total["b"] + 0.5) / (total["l"] + 1)
    smooth = lambda rate: (F.col("blocked") + smoothing * rate) / (F.col("labelled") + smoothing)
    hosts = stored(leaves.groupBy("host").agg(*sums).select("host", smooth(F.lit(overall)).alias("rate")), "hosts")
    tree = leaves.join(hosts, "host").withColumn("template", F.lit(""))
    for depth in range(1, min(max_depth, total["depth"]) + 1):
        tree = stored(tree.withColumn("seg", F.get("segs", F.lit(depth - 1))), "tree")
        node = ["host", "template"]
        children = stored(tree.where("seg is not null").groupBy(*node, "seg").agg(*sums, F.first("rate").alias("above")), "children")
        crowd = stored(children.groupBy(*node).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all_n")).where(F.col("kinds") > max_children), "crowded")
        rare = F.coalesce(F.col("n") < keep_share * F.col("all_n"), F.lit(False))
        named = stored(children.join(crowd, node, "left").withColumn("shown", F.when(rare, F.lit(WILD)).otherwise(F.col("seg"))), "named")
        # At most max_children, or 1 / keep_share and a wildcard, are left under a node, so the lists below are short.
        rate = F.col("blocked") / F.nullif(F.col("labelled"), F.lit(0))
        lists = (named.groupBy(*node, "shown").agg(*sums, F.first("above").alias("above"))
                 .groupBy(*node).agg(F.first("above").alias("above"),
                                     F.sort_array(F.collect_list(F.struct(rate.alias("rate"), F.col("shown").alias("seg"), "labelled", "blocked"))).alias("kids")))
        branches = (lists.select(*node, "above", F.explode(_merged(F.col("kids"))).alias("g")).select(*node, "above", "g.*")
                    .select(*node, F.explode("segs").alias("shown"), smooth(F.col("above")).alias("new_rate"),
                            F.when(F.size("segs") == 1, F.get("segs", F.lit(0)))
                            .otherwise(F.concat(F.lit("{"), F.array_join(F.array_sort("segs"), "|"), F.lit("}"))).alias("branch")))
        steps = stored(named.select(*node, "seg", "shown").join(stored(branches, "branches"), [*node, "shown"])
                       .select(*node, "seg", "branch", "new_rate"), "steps")
        tree = (tree.join(steps, [*node, "seg"], "left")
                .withColumns({"template": F.when(F.isnull("branch"), F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch")),
                              "rate": F.coalesce("new_rate", "rate")})
                .drop("branch", "new_rate", "seg"))
    return stored(tree.select("host", "segs", "template", "rate"), "templates")


def judge_urls(urls: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label: Column | None = None,
               threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: ``id, host, path, rule, verdict, template, rate``.

    A rule's verdict stands; other URLs get ``block`` if their template's smoothed rate of blocked labels reaches
    ``threshold``, else ``allow``. ``label`` (true: blocked, null: unknown) defaults to what the rules say. Null or other
    texts without a host fall under the host ''; without labels the rate is 0.5 everywhere; repeated rows count each; extra
    columns are ignored.
    """
    verdicts = dict((rule, verdict) for verdict, rule in rules)
    says = F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv])[F.col("rule")] if verdicts else F.lit(None).cast("string")
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = urls.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), *([label.alias("blocked")] if label is not None else []))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumns({"said": says, "segs": segments(F.col("path"))})
    if label is None:
        rows = rows.withColumn("blocked", F.col("said") == "block")
    tree = template_tree(rows.select("host", "segs", "blocked"))
    method = F.when(F.col("rate") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(tree, ["host", "segs"], "left").select("id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", "rate")
