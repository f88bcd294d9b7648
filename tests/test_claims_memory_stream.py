import json

from pyspark.sql import functions as F

from jobsieve.functions.replies import first_json_object, reply_text, strip_reasoning
from jobsieve.operators import claims as C
from jobsieve.operators import runs as R
from jobsieve.schema import HISTORY, VERDICTS, as_postings
from jobsieve.sources import memory as M
from jobsieve.streaming import intake as I

SAMPLE = "Senior Buyer CapsLock Remote Full-time $90K/yr - $120K/yr  Easy Apply to this job"


def verify(spark, fields, sample=SAMPLE, current=None):
    df = spark.createDataFrame([(fields, sample, current or {})], "fields map<string,string>, sample string, current map<string,string>")
    r = C.verify_claims(df).first()
    return r.accepted, {x.field: x.why for x in r.rejected}


def test_values_on_the_page_are_kept(spark):
    good = {"company": "capslock", "payText": "$90K/yr - $120K/yr", "workplaceType": "remote", "employmentType": "Full-time", "applyRoute": "easy_apply"}
    accepted, rejected = verify(spark, good)
    assert rejected == {} and accepted == {**good, "workplaceType": "Remote"}


def test_invented_values_are_refused(spark):
    accepted, why = verify(spark, {"company": "CapsLock Inc.", "payText": "$140,000", "workplaceType": "Hybrid", "seniority": "Director",
                                   "employmentType": "gig", "applyRoute": "call", "salary": "1", "title": "x" * 161})
    assert accepted == {}
    assert why == {
        "company": "not found in the page text", "payText": "not found in the page text", "workplaceType": "the page does not say it",
        "seniority": "the page does not say it", "salary": "not a field the model may fill", "title": "longer than a title can be",
        "employmentType": "not one of Full-time/Part-time/Contract/Temporary/Internship/Volunteer/Other",
        "applyRoute": "not one of easy_apply/external/unknown"}


def test_declined_taken_and_unearned(spark):
    for v in ("", "null", "None", "N/A", "unknown", "not stated"):
        assert verify(spark, {"company": v}) == ({}, {})
    assert verify(spark, {"company": "CapsLock"}, current={"company": "Acme"})[1] == {"company": "already read from the page"}
    assert verify(spark, {"applyRoute": "easy_apply"}, "Apply on company website")[1] == {"applyRoute": "nothing on the page says so"}
    assert verify(spark, {"applyRoute": "external"}, "Apply on company website")[0] == {"applyRoute": "external"}


def test_reply_shapes(spark):
    bodies = [{"choices": [{"message": {"content": "a"}}]}, {"choices": [{"message": {"content": [{"text": "b"}, {"x": 1}, {"text": "c"}]}}]},
              {"choices": [{"text": "d"}]}, {"choices": []}, {}]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "junk"), (10, None)]
    df = spark.createDataFrame(rows, "i int, b string").orderBy("i")
    assert [r[0] for r in df.select(reply_text("b")).collect()] == ["a", "bc", "d", "", "", "", ""]


def test_reasoning_and_first_object(spark):
    cases = ["<think>{</think>{\"a\":1}", "x <THINK>a</think> y", "cut <reasoning> never closed {", 'say {"a":"}{","b":{"c":"\\""}} end {"z":1}', "{'a': '}'} x",
             "no", '{"open": 1', None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").orderBy("i")
    clean = [r[0] for r in df.select(strip_reasoning("t")).collect()]
    assert clean[0].strip() == '{"a":1}' and clean[1].split() == ["x", "y"] and clean[2] == "cut "
    assert [r[0] for r in df.select(first_json_object(strip_reasoning("t"))).collect()] == [
        '{"a":1}', None, None, '{"a":"}{","b":{"c":"\\""}}', "{'a': '}'}", None, None, None]


def test_fields_and_plans(spark):
    texts = ['{"title":" A  b ","payText":120000,"company":null,"seniority":["x"],"zz":"1"}', "prose", '{"a":1} trailing', "{'a':1}",
             '{"selectors":{"card":["li"," ",".x"],"list":"BODY","title":"a\\nb","pills":"' + "p" * 301 + '"},"notes":" fine  then "}', '{"plan":{"card":"none"}}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    f = {r.i: (r.fields, r.error_why) for r in C.parse_fields(df).collect()}
    assert f[0] == ({"title": "A b", "payText": "120000"}, None) and f[1] == (None, "no JSON object in the reply")
    assert f[2] == ({}, None) and f[3][1] == "reply was not valid JSON"
    p = {r.i: (r.plan, r.notes, r.error_why) for r in C.parse_plan(df).collect()}
    assert p[4] == ({"card": "li, .x"}, "fine then", None) and p[5][2] == "the reply named no usable selector"


def test_apply_claims_records_the_model(spark):
    base = as_postings(spark.createDataFrame([("1", "", "Unknown"), ("2", "Keep", "Remote")], "job_id string, company string, workplace_type string"))
    acc = spark.createDataFrame([("1", "m", {"company": "Acme", "payText": "$90K/yr - $120K/yr", "applyRoute": "external"}), ("2", "m", {"payText": "soon"})],
                                "job_id string, model string, accepted map<string,string>")
    one, two = C.apply_claims(base, acc).orderBy("job_id").collect()
    assert (one.company, one.pay_min_annual, one.pay_source, one.apply_type) == ("Acme", 90000, "model", "external")
    assert one.ai_fields == {"company": "m", "pay": "m", "applyType": "m"}
    assert two.company == "Keep" and two.pay_source is None and two.ai_fields is None


def test_gaps_sample_and_messages(spark):
    df = as_postings(spark.createDataFrame([("1", "T", "Unknown", "C")], "job_id string, title string, workplace_type string, company string"))
    r = C.build_messages(C.field_gaps(df).withColumn("sample", C.prompt_sample("title", F.lit("b  c d")))).first()
    assert r.gaps == ["location", "workplaceType", "employmentType", "seniority", "payText", "applyRoute"]
    assert r.sample == "T\n\nb c d" and '"company"' not in r.messages[0].content and r.messages[1].role == "user"
    long = spark.range(1).select(C.prompt_sample(F.lit("head"), F.repeat(F.lit("x"), F.lit(9000)), 100).alias("s")).first().s
    assert len(long) == 100


def test_first_usable_reply(spark):
    rows = [("a", 0, "m0", 429, False), ("a", 1, "m1", 200, True), ("b", 0, "m0", 401, False), ("b", 1, "m1", 200, True),
            ("c", 0, "m0", 200, False), ("c", 1, "m1", 404, None), ("d", 0, "m0", 200, True), ("d", 1, "m1", 401, None)]
    df = spark.createDataFrame([(q, k, m, s, None, "t", u) for q, k, m, s, u in rows],
                               "request_id string, model_rank int, model string, status int, error string, text string, usable boolean")
    got = {r.request_id: r for r in C.first_usable_reply(df).collect()}
    assert {q: (r.ok, r.model) for q, r in got.items()} == {"a": (True, "m1"), "b": (False, None), "c": (False, None), "d": (True, "m0")}
    assert got["b"].error_why.startswith("the API key was rejected")
    assert got["c"].error_why == "every configured model failed: m0 (the reply could not be used); m1 (no such model (404))"


def test_call_budget_plan_limits_before_the_shuffle(spark):
    asks = spark.range(200).select((F.col("id") % 2).alias("run_id"), F.col("id").alias("seq"), (F.col("id") == 21).alias("rate_limited"))
    out = C.call_budget(asks)
    assert {r.run_id: r["count"] for r in out.groupBy("run_id").count().collect()} == {0: 30, 1: 11}
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_barren_streak_and_page_check(spark):
    pages = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, 0, 1, 0, 0, 0], 1)] + [("b", 1, 0), ("b", 2, 1)], "run_id string, page_no bigint, new_ids int")
    assert {r.run_id: r.stop_page for r in R.barren_streak(pages).collect()} == {"a": 5, "b": None}
    cards = spark.createDataFrame([(1, "x")] * 8 + [(2, "a"), (2, "b"), (3, None), (4, "a"), (4, "b"), (4, "c")], "page_id int, job_id string")
    assert {r.page_id: r.by_position for r in R.ids_per_page_check(cards).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_memory_newest_and_forget(spark, tmp_path):
    path = str(tmp_path / "history")
    assert M.read_memory(spark, path, HISTORY, "job_id", "exported_at").count() == 0
    rows = lambda *xs: spark.createDataFrame(list(xs), "job_id string, t string").select("job_id", F.to_timestamp("t").alias("exported_at"))
    M.upsert_memory(rows(("a", "2024-01-01"), ("b", "2024-01-01")), path)
    M.upsert_memory(rows(("a", "2024-02-01")), path)
    read = lambda p: {r.job_id: str(r.exported_at)[:10] for r in M.read_memory(spark, p, HISTORY, "job_id", "exported_at").collect()}
    assert read(path) == {"a": "2024-02-01", "b": "2024-01-01"}
    M.forget(spark.createDataFrame([("b",)], "job_id string"), path, HISTORY, "job_id", "exported_at", "2024-03-01")
    assert read(path) == {"a": "2024-02-01"}
    M.compact_memory(spark, path, str(tmp_path / "h2"), HISTORY, "job_id", "exported_at")
    assert read(str(tmp_path / "h2")) == {"a": "2024-02-01"}


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1, "s", "first"), ("a", 2, "s", "second"), ("b", 3, "s", "x")], "job_id string, seq bigint, source string, title string")
    M.append_postings(spark, rows, path)
    M.append_postings(spark, rows.withColumn("title", F.lit("later")), path)
    assert {r.job_id: r.title for r in M.read_postings(spark, path).collect()} == {"a": "first", "b": "x"}


def test_intake_resumes_from_its_checkpoint(spark, tmp_path):
    src, store, ck = (str(tmp_path / n) for n in ("src", "store", "ck"))
    cols = "job_id string, seq bigint, source string, title string"

    def drop(*rows):
        spark.createDataFrame(list(rows), cols).coalesce(1).write.mode("append").parquet(src)

    def run():
        I.stream_intake(I.read_arrivals(spark, src, cols, 1), store, ck, once=True).awaitTermination()

    drop(("a", 1, "s", "one"), ("a", 2, "s", "dup"))
    run()
    drop(("a", 3, "s", "late"), ("b", 4, "s", "two"))
    run()
    run()
    assert {r.job_id: r.title for r in M.read_postings(spark, store).collect()} == {"a": "one", "b": "two"}


def test_streamed_verdicts_and_counters(spark, tmp_path):
    src, mem, out = (str(tmp_path / n) for n in ("chat", "mem", "out"))
    cols = "conv_id bigint, turn bigint, text string"
    for turn, text in enumerate(["VERDICT 12345 ACCEPT\nVERDICT 77777 REJECT: no", "VERDICT 12345 REJECT: on reflection"]):
        spark.createDataFrame([(1, turn, text)], cols).coalesce(1).write.mode("append").parquet(src)
        I.stream_verdicts(I.read_arrivals(spark, src, cols), mem, str(tmp_path / "ck"), once=True).awaitTermination()
    got = {r.job_id: (r.verdict, r.reason) for r in M.read_memory(spark, mem, VERDICTS, "job_id", "at").collect()}
    assert got == {"12345": ("reject", "on reflection"), "77777": ("reject", "no")}
    evs = I.read_arrivals(spark, src, cols).select(F.lit("r").alias("run_id"), F.lit("collected").alias("outcome"))
    for _ in range(2):
        I.stream_counters(evs, out, str(tmp_path / "ck2"), once=True).awaitTermination()
    assert [(r.run_id, r.outcome, r.n) for r in I.read_counters(spark, out).collect()] == [("r", "collected", 2)]
