"""Every registered query with an SQL twin must agree with it; the smallest scale keeps this quick."""

import __spark_entry__ as entry
import duckdb
import pytest
from check_oracle import compare, connect

# One per area here; tests/check_oracle.py runs all of them at any scale.
SAMPLE = ["filter_combined", "filter_attribution", "search_top", "number_jobs", "extract_pay", "normalise_hits", "page_facts",
          "duplicate_guard", "verdicts_latest", "barren_streak", "pack_batches_grouped", "render_batches", "page_parts",
          "verify_claims", "first_usable_reply", "stream_verdicts", "refused_hits", "tag_rows_repeated", "stream_restart", "csv_file",
          "outline_lines", "verify_verbatim"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small, name):
    assert compare(spark, connect(small), entry.queries()[name], entry.oracle_sql()[name], small) is None


def test_verbatim_finds_items_of_any_length(spark, small, tmp_path):
    """Items of no, one, two and up to nine words, at the start, inside and at the end of words and texts."""
    con = connect(small)
    text = "The quick brown fox jumps over the lazy dog again and again"
    con.execute("create table t (doc_id bigint, text varchar)")
    con.executemany("insert into t values (?, ?)", [(1, text), (2, "he quick bro"), (3, ""), (4, None), (5, "x " + text.upper() + " y"), (6, "fox")])
    con.execute(f"copy t to '{tmp_path}/documents.parquet'")
    words = text.split()
    items = [" ".join(words[i: i + n]) for n in range(1, 10) for i in (0, 2, len(words) - n)]
    items += ["he quick bro", "ick b", "ox", "quick fox", "the fox jumps", "", None, " the  lazy ", "lazy fox jumps over the dog", "own fox jum"]
    con.execute("create table b (item_id varchar, text varchar)")
    con.executemany("insert into b values (?, ?)", [(f"i{k}", x) for k, x in enumerate(items)])
    con.execute(f"copy b to '{tmp_path}/benchmark.parquet'")
    con = connect_two(tmp_path)
    assert compare(spark, con, entry.queries()["verify_verbatim"], entry.oracle_sql()["verify_verbatim"], str(tmp_path)) is None


def connect_two(folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 300


def test_filters_reach_the_scan(spark, small):
    plan = entry.queries()["dedupe_first"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
