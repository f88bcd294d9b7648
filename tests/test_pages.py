"""Page structure, header facts, outlines and rule checks on rebuilt pages."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobsieve.functions import elements as EL
from jobsieve.functions import header as H
from jobsieve.functions.elements import read_page
from jobsieve.operators import blocks as B
from jobsieve.operators import outline as OL
from jobsieve.operators import pagefacts as P

PROSE = "We need an engineer with 5+ years of experience in data. " * 8
CARD = '<div class="k{i}"><a href="{href}">Role number {i}</a><p>Employer {i} somewhere in a large city</p></div>'


def card_list(n=4, href="/jobs/view/{i}00/"):
    return "".join(CARD.format(i=i, href=href.format(i=i)) for i in range(1, n + 1))


def two_pane(rail, title="Alpha Engineer", body=PROSE, label="<h2>About the job</h2>"):
    return (
        f'<html><body><nav><h2>3 messages</h2><a href="/company/none">None</a></nav><main><div class="rail"><section>{rail}</section>'
        f'</div><div class="pane"><div class="top"><h1>{title}</h1><a href="/company/acme">Acme 4,117 followers</a>'
        "<div>Tulsa, OK · Reposted 2 weeks ago · Over 90 applicants</div><span>Hybrid</span><span>Full-time</span>"
        '<span>$120K/yr - $150K/yr</span><button aria-label="Easy Apply to Alpha Engineer at Acme">Easy Apply</button></div>'
        f"<div>{label}<div><p>{body}</p><ul><li>one</li><li>two</li></ul></div></div></div></main></body></html>")


def parsed(spark, *htmls, url="https://b.example.com/jobs/search"):
    return B.html_blocks(spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id int, url string, html string"))


def test_element_numbers_and_lengths():
    page = read_page("<div id=a> x  <p>one<p>two <b>bold</b></div><ul><li>1<li>2</ul><br>tail<script>if(a<b){}</script>")
    els = page["els"]
    assert [(e["tag"], e["parent"], e["last"]) for e in els] == [
        ("div", None, 3), ("p", 0, 1), ("p", 0, 3), ("b", 2, 3), ("ul", None, 6), ("li", 4, 5), ("li", 4, 6), ("br", None, 7), ("script", None, 8)]
    for e in els:
        body = page["raw"][e["raw_start"]:e["raw_end"]]
        assert e["text_len"] == len(body.strip()) and e["norm_len"] == len(" ".join(body.split()))
    assert "if(a" not in page["rendered"] and [e["run"] for e in els[5:7]] == [2, 0]


@pytest.mark.parametrize("junk", [None, "", "plain", "<", "</p></div>", "<p", "<a href='x'", "<table><tr><td>a<td>b", "&#xZZ;&bogus;"])
def test_junk_never_fails(junk):
    page = read_page(junk)
    assert all(e["last"] >= e["ord"] for e in page["els"])


def test_parts_of_a_two_pane_page(spark):
    r = B.page_parts(parsed(spark, two_pane(card_list()))).first()
    assert (r.title, r.company, r.company_url) == ("Alpha Engineer", "Acme", "/company/acme")
    assert r.meta_line == "Tulsa, OK · Reposted 2 weeks ago · Over 90 applicants"
    assert {"Hybrid", "Full-time", "$120K/yr - $150K/yr"} <= set(r.pills)
    assert r.desc_via == "heading" and r.description.startswith("We need an engineer") and r.description.endswith("\n\n- one\n- two")
    assert r.apply_text == "Easy Apply"
    built = P.build_postings(B.page_parts(parsed(spark, two_pane(card_list()))).withColumn("job_id", F.lit("100"))).first()
    assert (built.location, built.workplace_type, built.posted_days_ago, built.applicants, built.reposted) == ("Tulsa, OK", "Hybrid", 14, 90, True)
    assert (built.apply_type, built.employment_type, built.pay_min_annual, built.pay_source, built.yoe_min) == (
        "easy_apply", "Full-time", 120000, "pill", 5)


def test_dense_block_when_no_heading(spark):
    r = B.page_parts(parsed(spark, two_pane(card_list(), label="", body=PROSE * 2))).first()
    assert r.desc_via == "dense" and "We need an engineer" in r.description and "Role number" not in r.description


def test_rail_is_never_the_description(spark):
    rail = "".join(f'<div><a href="/jobs/search?currentJobId={i}">{PROSE}</a></div>' for i in range(1, 6))
    page = f"<html><body><main><div>{rail}</div><div><p>short</p></div></main></body></html>"
    assert B.page_parts(parsed(spark, page)).first().description == ""


def test_cards_by_id_and_by_shape(spark):
    by_id = B.cards(parsed(spark, two_pane(card_list()))).collect()
    assert [r.job_id for r in sorted(by_id, key=lambda r: r.card_no)] == ["100", "200", "300", "400"]
    shape = two_pane(card_list(5, href="/jobs/opaque-{i}"))
    assert B.cards(parsed(spark, shape)).count() == 5
    assert B.cards(parsed(spark, shape, url="https://b.example.com/feed")).count() == 0
    people = two_pane(card_list(5, href="/in/person-{i}"))
    assert B.cards(parsed(spark, people)).count() == 0
    same = two_pane(card_list(6, href="/jobs/search?currentJobId=777"))
    assert B.cards(parsed(spark, same)).count() == 6


def test_groups_and_list_root(spark):
    p = parsed(spark, two_pane(card_list()))
    g = B.best_group(B.job_list_check(B.repeated_groups(p))).first()
    assert (g.shape, g.members) == ("DIV:2", 4)
    root = B.list_root(p).first().root
    assert root.tag == "section" and root.n_children == 4
    found = {r.pattern: r.n for r in B.discovery_breakdown(p).collect()}
    assert found['a[href*="/jobs/view/"]'] == 4 and found["[data-job-id]"] == 0


def test_page_work_needs_no_shuffle(spark):
    p = parsed(spark, two_pane(card_list()))
    for out in (B.page_parts(p), B.cards(p), B.repeated_groups(p), OL.page_outline(p)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("ArrowEvalPython [") <= 1, plan


def test_wide_routes(spark):
    linked = '<a href="/jobs/view/55/">Role</a>' + "<p>" + "header words " * 6 + "</p>"
    wrap = "<html><body><main><div><div>{link}</div>{rest}</div></main></body></html>"
    rests = ["<h2>About the job</h2><div>" + PROSE + "</div>", "<div><h2>About this role today</h2></div><div>" + PROSE + "</div>",
             "<div><p>" + PROSE + "</p></div>"]
    df = parsed(spark, *[wrap.format(link=linked, rest=r) for r in rests])
    got = {r.page_id: r.wide_via for r in B.header_region(df).select("page_id", "wide_via").collect()}
    assert got[0] == 'h2 "About the job", sibling' and got[1].startswith("heading, about-the-job family, ancestor +")
    assert got[2] == "largest block in the pane (no heading)"


def test_changed_block_is_the_description(spark):
    before, after = parsed(spark, two_pane(card_list())), parsed(spark, two_pane(card_list(), body=PROSE.replace("data", "law")))
    r = B.changed_blocks(before, after, key="page_id").first()
    block = B.block_rows(after).where(F.col("ord") == r.block_ord).first()
    assert r.n_leaves == 1 and block.norm_len == r.norm_len and block.tag == "div"
    assert B.changed_blocks(before, before, key="page_id").count() == 0


def test_leaves_of_nested_changes(spark):
    long = lambda w: f"{w} " * 120
    page = "<main><section><div><p>{}</p><p>{}</p></div><article>{}</article></section><aside>{}</aside></main>".format
    before = parsed(spark, page(*map(long, "abcd")))
    one = B.changed_blocks(before, parsed(spark, page(long("x"), *map(long, "bcd"))), key="page_id").first()
    two = B.changed_blocks(before, parsed(spark, page(long("x"), long("b"), long("y"), long("d"))), key="page_id").first()
    assert (one.n_leaves, two.n_leaves) == (1, 2) and one.n_changed >= 3 and two.n_changed > one.n_changed


def test_moved_blocks(spark):
    long = lambda w: f"{w} " * 120
    before = parsed(spark, f"<main><section><div>{long('a')}</div></section><div>{long('b')}</div><div>{long('c')}</div><div>{long('c')}</div></main>")
    after = parsed(spark, f"<main><article><section><div>{long('a')}</div></section></article><div>{long('z')}</div><section>{long('c')}</section></main>")
    got = B.moved_blocks(before, after, key="page_id").collect()
    assert [(r.tag, "section" in r.from_path, "article" in r.css_path) for r in got] == [("article", True, True)]
    assert B.moved_blocks(before, before, key="page_id").count() == 0
    assert B.moved_blocks(before.where("false"), after, key="page_id").count() == 0


def test_outline_and_audit(spark):
    p = parsed(spark, two_pane(card_list(6)))
    text = OL.page_outline(p).first().outline
    assert text.startswith("main\n") and "messages" not in text and PROSE not in text
    rules = {"list": {"tag": "section"}, "card": {"tag": "nav"}, "description": {"cls": "rail"}, "title": {"tag": "h1"},
             "company": {"tag": "body"}, "applyButton": {"tag": "h1"}, "other": {"tag": "a"}}
    why = {r.rule: r.why for r in OL.rule_audit(p, rules).collect()}
    assert why["list"] is None and why["title"] is None
    assert why["card"] == "matched 1 element(s), needs 3" and why["description"] == "overlaps the results list"
    assert why["company"] == "too broad to mean anything" and why["other"] == "not a field the collector uses"
    assert why["applyButton"] == 'nothing about "Alpha Engineer" says applyButton'
    assert OL.audit_summary(OL.rule_audit(p, rules)).count() == 7
    assert "distinct ids" in OL.page_digest(p).first().digest


def test_outline_is_cut_at_its_limit(spark):
    page = "<main>" + "".join(f"<{t} id='{'x' * 200}{i}'><b></b></{t}>" for i in range(60) for t in ("div", "p")) + "</main>"
    text = OL.page_outline(parsed(spark, page)).first().outline
    assert len(text) <= 16_100 and text.rstrip().endswith("lines") and "outline truncated at" in text


def test_runs_collapse(spark):
    text = OL.page_outline(parsed(spark, "<main><ul><li>a</li><li>b</li><li>c</li></ul><p>x</p><p>y</p></main>")).first().outline
    assert text == 'main\n  ul\n    li  "a"\n    … ×2 more siblings of the same shape\n  p  "x"'


def values(spark, fn, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(fn("c")).collect()]


def test_header_scalars(spark):
    assert values(spark, H.ago_to_days, ["5 hours ago", "2 days ago", "3 weeks ago", "1 month ago", "Reposted 2 years ago", "soon", None]) == [
        0, 2, 21, 30, 730, None, None]
    assert values(spark, H.parse_applicants, ["Over 1,200 applicants", "5 people clicked apply", "42 applicants", "x", None]) == [1200, 5, 42, None, None]
    assert values(spark, H.normalise_workplace, ["Remote", "ON-SITE", "on site", "Onsite", "office", None]) == [
        "Remote", "On-site", "On-site", "On-site", None, None]
    assert values(spark, H.company_text, ["Acme 4,117 followers", "Acme", "Fund 2K+ followers ", None]) == ["Acme", "Acme", "Fund", ""]
    assert values(spark, H.looks_like_title, ["CRA II", "About the job", "Is it?", "10+ results", "ab", "x" * 121, "0 notifications", None]) == [
        True, False, False, False, False, False, False, False]
    assert values(spark, H.job_id_from_href, ["/jobs/view/12/?x", "?currentJobId=34", "/a?x=1&jobId=5", "/jobs/12345", "/jobs/123456", None]) == [
        "12", "34", "5", None, "123456", None]
    assert values(spark, H.external_href, ["https://acme.com/a", "https://www.linkedin.com/x", "/rel", "#x", None]) == ["https://acme.com/a", "", "", "", ""]
    assert values(spark, H.host_label, ["https://www.acme.com/a", "no url at all"]) == ["acme.com", "no url at all"]


def test_ids_from_attributes(spark):
    cases = [{"data-job-id": " 77 "}, {"data-urn": "urn:li:jobPosting:88"}, {"href": "/jobs/view/99"}, {"data-job-id": "x", "href": "/jobs/view/5"}, {}]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, a map<string,string>")
    assert [r[0] for r in df.orderBy("i").select(H.job_id_from_attrs("a")).collect()] == ["77", "88", "99", "5", None]


def test_apply_precedence_and_thin_rows(spark):
    df = spark.createDataFrame([("No longer accepting", "Easy Apply", None), (None, "Easy Apply", None), (None, "Applied", None),
                                (None, "Go", "Apply on site"), (None, None, None)], "n string, t string, a string")
    assert [r[0] for r in df.select(H.apply_type("n", "t", "a")).collect()] == ["closed", "easy_apply", "applied", "external", "unknown"]
    thin = spark.createDataFrame([("x", "t", "c"), (PROSE, "", "c"), (PROSE, "About the job", "c"), (PROSE, "Title", ""), (PROSE, "Title", "c")],
                                 "d string, t string, c string")
    assert [r[0] for r in thin.select(H.thin_reason("d", "t", "c")).collect()] == [
        "description was 1 characters", "no title", 'the title came out as "About the job"', "no company", None]


def test_keyed_cards(spark):
    card = '<div role="button" componentkey="job-card-component-ref-{0}"><p>x</p></div>'
    page = "<main>" + "".join(card.format(i) for i in (11, 22, 22, 33)) + '<div componentkey="job-card-component-ref-44"></div></main>'
    assert [r.job_id for r in B.keyed_cards(parsed(spark, page)).orderBy("card_no").collect()] == ["11", "22", "33"]


def test_known_pages_are_skipped_before_parsing(spark):
    from jobsieve.plans.pipelines import collect_pages

    pages = spark.createDataFrame([(i, str(i), "u", two_pane(card_list())) for i in range(3)], "page_id int, job_id string, url string, html string")
    seen = spark.createDataFrame([("0",)], "job_id string")
    said = spark.createDataFrame([("1", "reject"), ("2", "accept")], "job_id string, verdict string")
    assert [r.job_id for r in collect_pages(pages, "page_id", seen, said).collect()] == ["2"]


def test_static_blocks_counts_texts_exactly(spark):
    """Many different texts at one place, each on two pages, and another place with one text on all."""
    pages = spark.range(6000).selectExpr(
        "if(id % 2 = 0, 'a', 'b') AS host",
        "array(struct('p.x' AS css_path, id div 4 AS text_hash), struct('p.y' AS css_path, 7L AS text_hash), struct('p.z' AS css_path, CAST(NULL AS BIGINT) AS text_hash)) AS els")
    got = {(r.host, r.css_path): (r.pages, r.texts) for r in B.static_blocks(pages, F.col("host")).collect()}
    assert got == {(h, p): (3000, n) for h in "ab" for p, n in (("p.x", 1500), ("p.y", 1))}


def plain_groups(page, text, kids, cap, members, parents, non_job=None):
    """Same-shaped siblings, one by one."""
    els, groups = page.els, {}
    for e in els:
        up = els[e.parent] if e.parent is not None else None
        if up is None or not text(e) or not kids[0] <= up.n_children <= kids[1] or not (up.tag in parents or "role" in up.attrs):
            continue
        groups.setdefault((e.parent, f"{e.tag.upper()}:{min(cap, e.n_children)}"), []).append(e)
    return {k: m for k, m in groups.items() if len(m) >= members}


def test_groups_links_and_cards_equal_plain_loops(spark):
    rail = card_list(5) + card_list(2, "/jobs/view/1{i}00/") + "".join(f'<p class="x"><a href="/in/p{i}">Person {i}</a> <b>of a large company with a name</b></p>' for i in range(4))
    pages = [two_pane(rail), two_pane(card_list(3, "/in/someone{i}")), two_pane("<ul>" + "<li>twenty characters are here</li>" * 3 + "</ul>"), "<p>none", "", None,
             "<div>" + '<a href="/jobs/view/77/">a</a><a href="/jobs/view/78/">b</a>' * 3 + "</div>"]
    df = parsed(spark, *pages)
    whole = {r.page_id: r for r in df.collect()}
    cards, turns = {}, {}
    for r in B.repeated_groups(df).collect():
        cards.setdefault(r.page_id, {})[r.parent, r["shape"]] = (r.members, r.first_ord, round(r.non_job_share * r.members))
    for r in B.turn_groups(df).collect():
        turns.setdefault(r.page_id, {})[r.parent, r["shape"]] = (r.members, r.first_ord, r.chars)
    seen = set()
    for i, page in whole.items():
        for e in page.els:
            assert e.n_links == sum(e.ord < k.ord <= e["last"] for k in page.links)

        def away(e, page=page):
            link = next((k for k in page.els if e.ord < k.ord <= e["last"] and k.tag == "a" and k.attrs.get("href") is not None), None)
            return bool(link and link.job_id is None and "/in/" in link.attrs["href"])

        want = plain_groups(page, lambda e: 40 <= e.text_len <= 1200 and e.n_children >= 1, (3, 60), 8, 3, B.GROUP_PARENTS)
        assert cards.get(i, {}) == {k: (len(m), m[0].ord, sum(map(away, m))) for k, m in want.items()}
        want = plain_groups(page, lambda e: e.text_len >= 20, (2, 400), 6, 2, B.GROUP_PARENTS)
        assert turns.get(i, {}) == {k: (len(m), m[0].ord, sum(e.norm_len for e in m)) for k, m in want.items()}
        seen.add((len(cards.get(i, {})) > 0, len(turns.get(i, {})) > 0))
    assert (True, True) in seen and (False, False) in seen
    got = [r.job_id for r in B.cards(df).where("page_id = 6").orderBy("card_no").collect()]
    assert got == ["77", "78"]


def test_page_work_grows_with_the_page(spark):
    """Twice the links, about twice the time."""
    import time

    def took(n):
        rail = "".join(f'<div class="k"><a href="/jobs/view/{1000 + i % 900}/">Role {i}</a><p>Employer {i} somewhere in a city</p></div>' for i in range(n))
        df = B.html_blocks(spark.createDataFrame([(1, "https://b.example.com/jobs/search", f"<main><section>{rail}</section><div>{PROSE}</div></main>")], "page_id int, url string, html string"))
        start = time.perf_counter()
        assert B.cards(df).count() == min(n, 900) and B.plausible_descriptions(df).select("plausible").first().plausible is not None
        B.turn_groups(df).count()
        return time.perf_counter() - start

    took(2500)
    assert took(20_000) < 24 * took(2500)  # 64 times if links met links


def test_reader_holds_few_pages_at_a_time():
    """A batch comes back in short pieces, by count and by size, so what Python holds does not grow with the rows of a task."""
    html = ["<main><p>one</p></main>", None, ""] * 400 + ["<p>" + "x" * 600_000 + "</p>"] * 4
    made = list(EL.parse_html.func(iter([pa.array(html), pa.array([], type=pa.string())])))
    assert [len(a) for a in made[-2:]] == [178, 2] and max(map(len, made)) <= EL.SLICE_PAGES
    assert [row for a in made for row in a.to_pylist()] == pa.array([read_page(h) for h in html], type=made[0].type).to_pylist()


def test_plain_markup_reads_as_the_standard_parser_reads_it(monkeypatch):
    bits = ["<div class='a'>", '<DIV ID="x&amp;y" hidden>', "</div>", "<p>", "</p >", "text &copy <", "</", "<!-- c -->", "<!--a--b-->", "<!-- a", "<!DOCTYPE html>", "<br/>",
            "<script>var x=\"</p>\";if(a<b){}</script>", "<script>a</b", "<style>p</STYLE>", "<script><!-- a </script>", "</script>", "<li>", "<a href=/jobs/view/2>", '<a b="', '"',
            '<p a="1"b="2">', '<p A="1" a="2">', '<p x=">" y="<b>">', "<svg/>", "<?pi x>", " \n", "\x1f", "😀", "<td>", "<table>", '<section aria-hidden="true">', "<x-y a>"]
    rng = random.Random(3)
    pages = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000)]
    assert sum(EL._walk_plain(h) is not None for h in pages) > 100
    mine = [read_page(h) for h in pages]
    monkeypatch.setattr(EL, "_walk_plain", lambda html: None)
    assert mine == [read_page(h) for h in pages]


def test_reader_names_jobs_and_counts_links_as_the_rules_say(spark):
    """Ids, links and lists come with the elements: nothing is worked out again per element after the reader."""
    rng = random.Random(11)
    names = [*H.ID_ATTRS, *H.URN_ATTRS, "href", "class"]
    values = ["", " 12 ", "12", "12\n", "1\r\n", "12\n\n", "x1", "٣", "urn:jobPosting:77", "urn:jobPosting:٣", "jobPosting", "/jobs/view/5/?currentJobId=6",
              "/jobs/view/", "?jobId=8", "/jobs/123456", "/jobs/12345", "/x?a=1&currentJobId=9"]
    tags = ["a", "li", "div", "ul", "section", "p"]
    pages = []
    for _ in range(300):
        bits = [f"<{rng.choice(tags)} " + " ".join(f'{n}="{rng.choice(values)}"' for n in rng.sample(names, 2)) + ">" if rng.random() < 0.6 else rng.choice(["</a>", "</div>", "</ul>", "<div>", "x"])
                for _ in range(rng.randint(1, 30))]
        pages.append("<html><body>" + "".join(bits))
    df = B.list_root(parsed(spark, *pages))
    rows = df.withColumn("ids", F.transform("els", lambda e: F.when(F.size(e["attrs"]) > 0, H.job_id_from_attrs(e["attrs"])))).collect()
    lists = 0
    for r in rows:
        assert [e.job_id for e in r.els] == r.ids
        links = [e for e in r.els if e.job_id is not None and (
            e.tag == "a" and any(p in e.attrs.get("href", "") for p in ("/jobs/view/", "currentJobId=", "jobId="))
            or any(n in e.attrs for n in H.ID_ATTRS) or any("jobPosting" in e.attrs.get(n, "") for n in H.URN_ATTRS))]
        assert [k.ord for k in r.links] == [k.ord for k in links]
        near = [0] * len(r.els)
        for k in links:
            at = k.parent
            for _ in range(10):
                if at is None:
                    break
                near[at], at = near[at] + 1, r.els[at].parent
        best = None
        for e in r.els:
            if near[e.ord] and e.tag != "html" and (best is None or near[e.ord] > near[best.ord] or (near[e.ord] == near[best.ord] and e.ord <= best["last"])):
                best = e
        assert (r.root and r.root.ord) == (best.ord if best and len(links) >= 2 else None)
        lists += r.root is not None
    assert lists > 50 and any(r.ids[0] is None for r in rows)
