import json

from pyspark.sql import functions as F

from jobsieve.operators import hits as N
from jobsieve.operators import verdicts as V


def page(hits, **props):
    doc = {"props": {"pageProps": {"ssrHits": hits, **props}}}
    return f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(doc)}</script></html>'


def one(spark, hit, text=None, **kw):
    pages = spark.createDataFrame([(page([hit]),)], "html string")
    rows = N.explode_hits(N.read_search_pages(pages))
    if text is not None:
        rows = rows.withColumn("full_text", F.lit(text))
    got = N.normalise_hit(rows, now_ms=1_000 * 86_400_000, **kw).collect()
    return got[0] if got else None


def hit(**data):
    top = {k: data.pop(k) for k in list(data) if k in ("id", "objectID", "apply_url", "is_expired", "job_information")}
    return {"id": "a1", **top, "v5_processed_job_data": data}


def test_envelopes(spark):
    good = page([hit(), hit(id="b")], ssrPage=2, ssrTotalCount=70, ssrIsLastPage=False)
    cases = [good, page([]), page({"not": "a list"}), "<html>", good.replace("</script>", "").replace("}}}", ""),
             page([hit()], ssrError="boom"), None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, html string")
    got = [(r.i, r.n, r.page, r.total, r.last_page, r.error) for r in N.read_search_pages(df).select(
        "i", F.size("hits").alias("n"), "page", "total", "last_page", "error").orderBy("i").collect()]
    none = "no __NEXT_DATA__ pageProps"
    assert got == [(0, 2, 2, 70, False, None), (1, 0, 0, None, True, None), (2, 0, 0, None, True, None),
                   (3, 0, 0, None, True, none), (4, 0, 0, None, True, none), (5, 1, 0, None, False, "boom"),
                   (6, 0, 0, None, True, none)]


def test_missing_everything_is_null_not_zero(spark):
    r = one(spark, {"id": "x"})
    assert (r.pay_min_annual, r.yoe_min, r.travel_pct, r.needs_clearance, r.sponsorship_unavailable, r.applicants) == (None,) * 6
    assert r.workplace_type == "Unknown" and r.description_source == "none" and r.apply_type == "unknown"
    assert r.dedup_key == "x"


def test_ids(spark):
    assert one(spark, {"objectID": "o"}).job_id == "o"
    assert one(spark, {"id": "", "objectID": ""}) is None


def test_pay_variants(spark):
    def get(**v):
        r = one(spark, hit(**v))
        return (r.pay_min_annual, r.pay_max_annual, r.pay_raw, r.pay_source)

    assert get(yearly_min_compensation=89889.904, yearly_max_compensation=120000) == (
        89890, 120000, "$89,890 - $120,000", "hiringcafe:yearly")
    assert get(hourly_min_compensation=50.0) == (104000, None, "$104,000", "hiringcafe:hourly")
    assert get(yearly_min_compensation=1, listed_compensation_currency="EUR") == (None, None, "", "")
    assert get(yearly_min_compensation="90000") == (None, None, "", "")
    assert get(yearly_max_compensation=100, yearly_min_compensation=100)[2] == "$100"


def test_tri_states(spark):
    assert one(spark, hit(security_clearance="None")).needs_clearance is False
    assert one(spark, hit(security_clearance="Secret")).needs_clearance is True
    assert one(spark, hit(visa_sponsorship=True)).sponsorship_unavailable is False
    assert one(spark, hit(visa_sponsorship=False)).sponsorship_unavailable is None
    yes = dict(min_industry_and_role_yoe=4, is_min_industry_and_role_yoe_not_mentioned=False)
    assert one(spark, hit(**yes)).yoe_min == 4
    assert one(spark, hit(**{**yes, "is_min_industry_and_role_yoe_not_mentioned": None})).yoe_min is None


def test_travel(spark):
    def get(a, b):
        return one(spark, hit(air_travel_requirement=a, land_travel_requirement=b)).travel_pct

    assert [get("Extensive", "None"), get("None", "Occasional x"), get("None", ""), get("", ""), get("varies", "None")] == [
        75, 25, 0, None, None]


def test_description_and_prose_fill(spark):
    h = hit(requirements_summary=" short ", technical_tools=["SQL", " "], workplace_type="Field")
    r = one(spark, h)
    assert (r.description, r.description_source) == ("short\n\nTools and systems: SQL", "hiringcafe:summary")
    assert (r.workplace_type, r.workplace_raw) == ("Unknown", "Field")
    full = one(spark, h, text="Must relocate. 5+ years of experience.", fill_from_prose=True)
    assert full.description_source == "hiringcafe:full" and full.requires_relocation and full.yoe_min == 5
    plain = one(spark, h, text="Must relocate. 5+ years of experience.")
    assert plain.requires_relocation is None and plain.yoe_min is None


def test_expired_middle_hit_does_not_shift_descriptions(spark):
    hits = [hit(id="a"), hit(id="b", is_expired=True), hit(id="c")]
    rows = N.drop_expired(N.explode_hits(N.read_search_pages(spark.createDataFrame([(page(hits),)], "html string"))))
    bodies = [(i, json.dumps({"job": {"job_information": {"description": f"<p>text {i}</p>"}}})) for i in "abc"]
    det = N.read_detail_json(spark.createDataFrame([*bodies, ("z", "junk")], "job_id string, body string"))
    got = N.normalise_hit(N.join_descriptions(rows, det), now_ms=0).collect()
    assert {r.job_id: r.description for r in got} == {"a": "text a", "c": "text c"}


def test_scalars(spark):
    df = spark.createDataFrame([("r86400",), ("r1",), ("r604800",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(N.days_from_posted("c")).collect()] == [1, 1, 7, None, None]
    names = spark.createDataFrame([("UK",), ("Portugal",), (" ",), (None,)], "c string")
    assert [r[0] for r in names.select(N.country_code("c")).collect()] == ["GB", "PO", None, None]


LINES = [
    ("VERDICT 4266112233 ACCEPT", ("4266112233", "accept", "", "strict")),
    ("VERDICT 4266112233 REJECT: too junior", ("4266112233", "reject", "too junior", "strict")),
    ("VERDICT 4266112233 REJECT - too junior", ("4266112233", "reject", "too junior", "strict")),
    ("verdict ab12cd34 accept", ("ab12cd34", "accept", "", "strict")),
    ("4266112233: reject, no direct exp", ("4266112233", "reject", "no direct exp", "loose")),
    ("pass on 4266112233", ("4266112233", "reject", "", "loose")),
    ("reject 4266112233: too senior", ("4266112233", "reject", "too senior", "loose")),
    ("#4266112233 - pursue", ("4266112233", "accept", "", "loose")),
    ("This job is similar to 4266112233.", None), ("VERDICT: still deciding on 4266112233", None),
    ("We rejected about 40% of applicants last cycle.", None), ("VERDICT 111111111 222222222 ACCEPT", None),
    ("reject 123", None), ("No sponsorship is offered for 4266112233.", None),
]


def test_verdict_lines(spark):
    chats = spark.createDataFrame([(i, 0, t) for i, (t, _) in enumerate(LINES)], "conv_id int, turn int, text string")
    lines = V.read_chat_lines(chats)
    got = {r.conv_id: (r.job_id, r.verdict, r.reason, r.confidence) for r in V.parse_verdicts(lines).collect()}
    assert got == {i: w for i, (_, w) in enumerate(LINES) if w}
    assert [r.line for r in V.ambiguous_lines(lines).collect()] == ["VERDICT 111111111 222222222 ACCEPT"]


def test_later_line_wins_even_when_loose(spark):
    text = "VERDICT 4266112233 ACCEPT\r\nOn reflection:\n4266112233: reject, changed my mind\n\n"
    lines = V.read_chat_lines(spark.createDataFrame([(1, 1, text)], "conv_id int, turn int, text string"))
    r = V.latest_verdict(V.parse_verdicts(lines)).collect()
    assert [(x.job_id, x.verdict, x.reason) for x in r] == [("4266112233", "reject", "changed my mind")]


def test_merge_counts(spark):
    cols = "job_id string, verdict string, reason string"
    store = spark.createDataFrame([("a", "accept", ""), ("b", "reject", "")], cols)
    batch = spark.createDataFrame([("b", "accept", "x"), ("c", "reject", "")], cols)
    merged, counts = V.merge_verdicts(store, batch)
    assert {r.job_id: r.verdict for r in merged.collect()} == {"a": "accept", "b": "accept", "c": "reject"}
    assert counts.first().asDict() == {"added": 1, "updated": 1, "total": 3}


def test_scan_into_store(spark):
    from jobsieve.plans.pipelines import scan_verdicts, tag_rows

    store = spark.createDataFrame([("12345", "accept", "", "s")], "job_id string, verdict string, reason string, source string").select(
        "job_id", "verdict", "reason", F.lit(None).cast("timestamp").alias("at"), "source")
    chats = spark.createDataFrame([(1, 0, "VERDICT 12345 REJECT: no\nVERDICT 99999 ACCEPT\nreject 11111 or 22222 accept?")], "conv_id int, turn int, text string")
    merged, counts, unclear = scan_verdicts(chats, store)
    assert {r.job_id: r.verdict for r in merged.collect()} == {"12345": "reject", "99999": "accept", "11111": "reject"}
    assert counts.first().asDict() == {"added": 2, "updated": 1, "total": 3} and unclear.count() == 0
    rows = spark.createDataFrame([("12345",), ("5",)], "job_id string")
    tagged = {r.job_id: (r.seen, r.verdict) for r in tag_rows(rows, rows.where("job_id = '5'"), merged).collect()}
    assert tagged == {"12345": (False, "reject"), "5": (True, None)}


def test_collect_drops_caps_and_skips_before_the_join(spark):
    from jobsieve.plans.pipelines import collect_structured

    pages = [(1, page([hit(id="a"), hit(id="b", is_expired=True), hit(id="c")])), (2, page([hit(id="a"), hit(id="d")])), (3, page([hit(id="e")]))]
    det = spark.createDataFrame([("c", json.dumps({"job": {"job_information": {"description": "full c"}}}))], "job_id string, body string")
    df = spark.createDataFrame(pages, "page_no int, html string")
    got = {r.job_id: r.description for r in collect_structured(df, det, now_ms=0, max_jobs=3, max_pages=2).collect()}
    assert got == {"a": "", "c": "full c", "d": ""}
    known = spark.createDataFrame([("a",)], "job_id string")
    assert {r.job_id for r in collect_structured(df, det, now_ms=0, known=known).collect()} == {"c", "d", "e"}
