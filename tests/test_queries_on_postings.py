"""Filters, search, order, dedupe, export: behaviour on small hand-made postings."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobsieve.operators import dedupe as D
from jobsieve.operators import exporting as E
from jobsieve.operators import filters as FL
from jobsieve.operators import ordering as O
from jobsieve.operators import search as S
from jobsieve.plans import pipelines as L
from jobsieve.plans.views import postings
from jobsieve.schema import POSTING, as_postings
from jobsieve.sources import sinks

BASE = dict(job_id="1", title="CRA II", company="Acme CRO", location="Boston, MA", workplace_type="Remote", posted_raw="3 days ago",
            posted_days_ago=3, reposted=False, promoted=False, applicants=12, apply_type="external", employment_type="Full-time",
            seniority="Mid-Senior level", description="Monitor oncology trials.", description_chars=24, url="https://x/1", seq=1)


def jobs(spark, *changes):
    rows = [{**BASE, "job_id": str(i), "seq": i, **c} for i, c in enumerate(changes, 1)]
    names = list(POSTING)
    schema = ", ".join(f"{k} {v}" for k, v in POSTING.items())
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def ids(df):
    return [r.job_id for r in df.orderBy("seq").collect()]


KEEPS_UNKNOWN = [
    (dict(workplace=("Hybrid",)), dict(workplace_type=None)), (dict(workplace=("Hybrid",)), dict(workplace_type="Unknown")),
    (dict(apply=("easy_apply",)), dict(apply_type=None)), (dict(max_days="1"), dict(posted_days_ago=None)),
    (dict(max_applicants="1"), dict(applicants=None)), (dict(min_pay="1000000"), {}), (dict(max_yoe="0"), {}),
    (dict(max_travel="0"), {}), (dict(no_clearance=True), {}), (dict(no_sponsor=True), {}), (dict(no_reloc=True), {}),
    (dict(no_repost=True), dict(reposted=None)), (dict(title_not="x"), dict(title=None)),
    (dict(company_not="x"), dict(company=None)), (dict(jd_not="x"), dict(description=None)),
]
DROPS = [
    (dict(workplace=("Hybrid",)), {}), (dict(apply=("easy_apply",)), {}), (dict(max_days="1"), {}), (dict(max_applicants="1"), {}),
    (dict(has_pay=True), {}), (dict(min_chars="100"), dict(description_chars=None)), (dict(title_any="nurse"), dict(title=None)),
    (dict(jd_all="oncology, x"), {}), (dict(jd_any="x,y"), dict(description=None)), (dict(no_clearance=True), dict(needs_clearance=True)),
    (dict(min_pay="130000"), dict(pay_min_annual=100000, pay_max_annual=120000)), (dict(max_days="0"), {}),
]


def test_unknown_is_never_a_rejection(spark):
    for spec, change in KEEPS_UNKNOWN:
        assert ids(FL.apply_filters(jobs(spark, change), FL.FilterSpec(**spec))) == ["1"], spec


def test_known_mismatch_is_dropped(spark):
    for spec, change in DROPS:
        assert ids(FL.apply_filters(jobs(spark, change), FL.FilterSpec(**spec))) == [], spec


def test_top_of_range_clears_the_floor(spark):
    df = jobs(spark, dict(pay_min_annual=110000, pay_max_annual=140000), dict(pay_min_annual=110000))
    assert ids(FL.apply_filters(df, FL.FilterSpec(min_pay="130000"))) == ["1"]


def test_spec_numbers_and_active_keys():
    assert [FL.spec_number(x) for x in ("", " ", "0", "x", 5, "1.5")] == [None, None, 0, None, 5, 1.5]
    assert FL.spec_number("3", floor=10) == 10
    assert FL.active_filters(FL.FilterSpec(min_chars="0", max_days="0", no_seen=True, title_any=" ", workplace=("Remote",))) == [
        "workplace", "no_seen", "max_days"]
    assert FL.split_list(" A, b ,,") == ["a", "b"]


def test_memory_filters_and_attribution(spark):
    df = jobs(spark, {}, dict(workplace_type="Hybrid"), {}, dict(reposted=True))
    seen = spark.createDataFrame([("1",)], "job_id string")
    said = spark.createDataFrame([("3", "reject"), ("1", "accept")], "job_id string, verdict string")
    spec = FL.FilterSpec(no_seen=True, no_rejected=True, no_repost=True, workplace=("Remote",), max_yoe="1")
    assert ids(FL.apply_filters(df, spec, seen, said)) == []
    by = [(r.key, r.removed) for r in FL.filter_attribution(df, spec, seen, said).collect()]
    assert by == [("workplace", 1), ("no_repost", 1), ("no_seen", 1), ("no_rejected", 1)]
    note = FL.explain_empty(df, spec, seen, said).first().note
    assert note.startswith("All 4 collected jobs are filtered out — ") and "and 1 more" in note
    assert FL.explain_empty(df, FL.FilterSpec()).count() == 0


def test_no_join_unless_asked(spark):
    plan = FL.apply_filters(jobs(spark, {}), FL.FilterSpec(max_days="3"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_search_order(spark):
    df = jobs(spark, dict(description="they mention zeta here"), dict(location="Zeta, MA"), dict(title="zeta lead"), dict(company="Zeta"),
              dict(company="Other", title="x"))
    got = O.sort_jobs(S.search(df, "ZETA"), "collected", "zeta").collect()
    assert [r.job_id for r in got] == ["4", "3", "2", "1"] and [r.score for r in got] == [120, 60, 24, 3]
    assert ids(S.search(df, "zeta nowhere")) == []
    assert [r.score for r in S.search(df, "5").collect()] == [100]
    assert S.search(df, "  ").count() == 5


def test_sorts_are_stable(spark):
    df = jobs(spark, dict(posted_days_ago=None), dict(posted_days_ago=2), dict(posted_days_ago=2), dict(pay_min_annual=5))
    assert [r.job_id for r in O.sort_jobs(df, "posted").collect()] == ["2", "3", "4", "1"]
    assert [r.job_id for r in O.sort_jobs(df, "pay").collect()] == ["4", "1", "2", "3"]


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 7).repartition(6)
    got = O.number_rows(df, ["k", F.col("id").desc()], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001))
    assert [(r.k, -r.id) for r in got] == sorted((r.k, -r.id) for r in got)


def test_dedupe_is_first_wins_and_idempotent(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z")], "job_id string, seq bigint, v string")
    once = D.dedupe_first(df)
    assert sorted((r.job_id, r.v) for r in once.collect()) == [("a", "y"), ("b", "z")]
    assert D.dedupe_first(once).count() == 2


def test_duplicate_guard_with_one_hot_text(spark):
    text = "same words " * 30
    rows = [(str(i), i, text.replace(" ", "  ") if i % 3 == 0 else text) for i in range(300)]
    rows += [(f"u{i}", 1000 + i, f"{i} " + text) for i in range(50)] + [(f"s{i}", 2000 + i, "short") for i in range(50)]
    rows += [("0", 3000, text)]
    kept, dropped = D.split_duplicates(spark.createDataFrame(rows, "job_id string, seq bigint, description string"))
    assert kept.count() == 1 + 1 + 50 + 50
    assert {r.owner_id for r in dropped.collect()} == {"0"} and dropped.count() == 299


def greedy(lengths, budget):
    out, batch, used, n = [], 1, 0, 0
    for size in lengths:
        if n and (used + size > budget or n >= 15):
            batch, used, n = batch + 1, 0, 0
        used, n = used + size, n + 1
        out.append(batch)
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_packing_equals_sequential(spark, seed):
    rnd = random.Random(seed)
    rows = [(str(i), rnd.choice("aab"), i, rnd.choice([50, 400, 900, 2500, 7000])) for i in range(rnd.randint(1, 700))]
    df = spark.createDataFrame(rows, "job_id string, g string, job_no bigint, size bigint")
    got = E.pack_batches(df, ["job_no"], 5000, length=F.col("size"), chunk_rows=20, fan_in=4).collect()
    assert [r.batch_no for r in sorted(got, key=lambda r: r.pos)] == greedy([r[3] for r in rows], 5000)
    if seed % 2:
        got = E.pack_batches(df, ["job_no"], 5000, group="g", length=F.col("size"), chunk_rows=16, fan_in=3).collect()
        for g in {r[1] for r in rows}:
            mine = [r.batch_no for r in sorted(got, key=lambda r: r.pos) if r.g == g]
            assert mine == greedy([r[3] for r in rows if r[1] == g], 5000)


def test_texts_stay_out_of_the_sort(spark, small):
    """Descriptions meet their batch by id; what is range-sorted and written holds ids, sort values and lengths."""
    batches = L.export_batches(postings(spark, small), FL.FilterSpec(sort="pay"))
    plan = batches._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan  # the sorted part was written before, and only its slim rows are read
    slim = E.with_blocks(postings(spark, small))
    assert {"job_no", "block_chars", "block"} <= set(slim.columns)
    assert all(r.n == r.block_chars for r in slim.select(F.length("block").alias("n"), "block_chars").collect())


@pytest.mark.parametrize("n, sizes", [(1, [1]), (16, [15, 1]), (40, [15, 15, 10])])
def test_rendered_batches(spark, n, sizes):
    blocks = E.with_blocks(jobs(spark, *[{} for _ in range(n)]))
    out = E.render_batches(blocks, E.pack_batches(blocks, ["job_no"]), prompt="P", reply_format=" R ").orderBy("batch_no").collect()
    assert [r.n_jobs for r in out] == sizes
    assert out[0].text.startswith(f"P\n\nR\n\n=== BATCH 1 of {len(sizes)} — {sizes[0]} jobs ===\n\n--- JOB 1 | ID 1 ---\nTitle: CRA II")


def test_block_lines(spark):
    full = dict(pay_raw="$120,000", pay_min_annual=120000, pay_source="jd", yoe_min=5, travel_pct=40, needs_clearance=True, tools=["SQL"],
                apply_url="https://a/b", reposted=True, promoted=True, applicants=None)
    block = E.with_blocks(jobs(spark, full, {}), max_chars=7).orderBy("seq").collect()
    assert ("PARSED FACTS: Pay: $120,000 (annualized 120,000) [source: description text] | Years required: 5+ | Travel: up to 40% | "
            "Security clearance required | Tools listed: SQL | Direct apply URL: https://a/b") in block[0].block
    assert "Posted: 3 days ago [REPOSTED]\nApplicants: unknown\nApply route: Direct apply [PROMOTED]\n" in block[0].block
    assert block[0].block.endswith("\n\nJOB DESCRIPTION:\nMonitor\n[...trimmed]\n")
    assert "PARSED FACTS" not in block[1].block and "Details: Full-time | Mid-Senior level\nSource: LinkedIn" in block[1].block


def test_csv_sink(spark, tmp_path):
    df = jobs(spark, dict(title="a, b", description='line "one"\nline two'), dict(description="plain"))
    sinks.write_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_bytes().decode("utf-8") for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.startswith("﻿jobId,title,company") and text.count("\r\n") == 3
    assert '"a, b"' in text and '"line ""one""\nline two"\r\n' in text


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("1", 5)], "job_id string, yoe_min int")
    b = spark.createDataFrame([("2", "k")], "job_id string, dedup_key string")
    from jobsieve.schema import union_postings

    got = {r.job_id: (r.yoe_min, r.dedup_key) for r in union_postings(a, b).collect()}
    assert got == {"1": (5, None), "2": (None, "k")} and as_postings(a).columns == list(POSTING)
