"""The posting store by buckets of ids, and the intake whose state knows the ids it has seen."""

import datetime as dt

import __spark_entry__ as entry
import pytest
from check_oracle import compare, connect
from jobsieve.operators.dedupe import dedupe_first
from jobsieve.schema import POSTING, as_postings, ddl
from jobsieve.sources import memory as M
from jobsieve.streaming import intake as I
from pyspark.sql import functions as F

COLS = "job_id string, seq bigint, source string, title string"


def stored(spark, path):
    return sorted(((r.job_id, r.seq, r.source, r.title) for r in M.read_postings(spark, path).collect()), key=str)


@pytest.mark.parametrize("name", ["stream_batches", "append_batches", "stream_restart", "stream_intake"])
def test_query_equals_sql(spark, small, name):
    assert compare(spark, connect(small), entry.queries()[name], entry.oracle_sql()[name], small) is None


def test_append_opens_touched_folders_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    many = spark.range(500).selectExpr("cast(id as string) as job_id", "id as seq", "'s' as source", "'old' as title")
    M.append_postings(spark, many, path)
    opened = []
    layout = M._layout
    monkeypatch.setattr(M, "_layout", lambda s, p, *folders: opened.extend(folders) or layout(s, p, *folders))
    batch = spark.createDataFrame([("7", 900, "s", "new"), ("x1", 901, "t", "new"), ("x1", 902, "t", "later"), (None, 903, None, "none"), (None, 904, None, "none")], COLS)
    M.append_postings(spark, batch, path)
    touched = {r.b for r in batch.select(M.bucket("job_id").alias("b")).distinct().collect()}
    assert {int(f.rsplit("=")[-1]) for f in opened} <= touched and len(touched) < M.STORE_BUCKETS
    got = {r[0]: r[3] for r in stored(spark, path)}
    assert got["7"] == "old" and got["x1"] == "new" and got[None] == "none" and len(got) == 502
    M.append_postings(spark, batch, path)
    assert len(stored(spark, path)) == 502


def test_large_batches_look_up_every_id(spark, tmp_path):
    """Beyond the ids that are asked for by name, the batch meets the folders in a join."""
    path = str(tmp_path / "store")
    rows = spark.range(3000).selectExpr("cast(id as string) as job_id", "id as seq", "if(id % 3 = 0, 'a', null) as source", "'t' as title")
    M.append_postings(spark, rows.where("seq < 1000"), path)
    M.append_postings(spark, rows, path)
    M.append_postings(spark, rows.where("false"), path)
    assert len(stored(spark, path)) == 3000


def test_token_makes_a_write_its_own(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = as_postings(spark.createDataFrame([("a", 1, "s", "one"), ("b", 2, None, "two")], COLS))
    for _ in range(2):
        M.write_postings(rows, path, "w1")
    M.write_postings(as_postings(spark.createDataFrame([("c", 3, "s", "three")], COLS)), path, "w2")
    assert [r[0] for r in stored(spark, path)] == ["a", "b", "c"]


def drop(spark, src, *rows):
    spark.createDataFrame(list(rows), COLS).coalesce(1).write.mode("append").parquet(src)


def run(spark, src, store, ck):
    I.stream_intake(I.read_arrivals(spark, src, COLS, 1), store, ck, once=True).awaitTermination()


def test_state_not_the_store_knows_what_was_seen(spark, tmp_path):
    src, store, other, ck = (str(tmp_path / n) for n in ("src", "store", "other", "ck"))
    M.append_postings(spark, spark.createDataFrame([("old", 0, "s", "before the stream")], COLS), store)
    drop(spark, src, ("a", 2, "s", "second"), ("a", 1, "s", "first"), ("old", 3, "s", "again"), (None, 4, None, "none"), ("n", None, "s", "late"), ("n", 9, "s", "ordered"))
    run(spark, src, store, ck)
    assert {r[0]: r[3] for r in stored(spark, store)} == {"old": "before the stream", "a": "first", None: "none", "n": "ordered"}
    # The stream goes on into an empty folder: what it saw before is known all the same.
    drop(spark, src, ("a", 5, "s", "again"), ("b", 6, "t", "new"), (None, 7, "s", "none"), ("old", 8, "s", "again"))
    run(spark, src, other, ck)
    assert stored(spark, other) == [("b", 6, "t", "new")]


def test_whole_rows_pass_the_state(spark, tmp_path):
    """Every column of a posting, nested ones too, comes out as it went in."""
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    values = {"string": "é𝄞", "int": 7, "bigint": 1 << 40, "double": 0.1, "boolean": True, "timestamp": dt.datetime(2024, 5, 6, 7, 8, 9, 123456),
              "array<string>": ["a", None], "map<string,string>": {"k": None, "x": "y"}, "array<struct<years:int,snippet:string>>": [(3, "three")]}
    full = {c: values[k] for c, k in POSTING.items()}
    rows = spark.createDataFrame([tuple(full.values()), ("empty", *[None] * (len(POSTING) - 1))], ddl(POSTING))
    rows.write.parquet(src)
    I.stream_intake(I.read_arrivals(spark, src, ddl(POSTING)), store, str(tmp_path / "ck"), once=True).awaitTermination()
    assert sorted(map(str, M.read_postings(spark, store).collect())) == sorted(map(str, rows.collect()))


def test_batches_equal_one_pass(spark, tmp_path):
    src, store, ck = (str(tmp_path / n) for n in ("src", "store", "ck"))
    rows = [(f"u{(i * 7) % 23}", i, f"s{i % 2}", f"t{i}") for i in range(120)]
    for a in range(0, 120, 40):
        for b in range(a, a + 40, 20):
            drop(spark, src, *rows[b: b + 20])
        run(spark, src, store, ck)
    want = dedupe_first(spark.createDataFrame(rows, COLS)).collect()
    assert stored(spark, store) == sorted(((r.job_id, r.seq, r.source, r.title) for r in want), key=str)


def test_files_are_as_large_as_their_rows(spark, tmp_path):
    """64 files of a few ids each: no fixed megabyte of Bloom filter in each. Without adaptive execution, as in a stream, a folder gets one file."""
    def files(path):
        return [f for f in path.rglob("*.parquet")]

    rows = as_postings(spark.range(640).repartition(8).selectExpr("cast(id as string) as job_id", "id as seq", "'s' as source", "'t' as title"))
    M.write_postings(rows, str(tmp_path / "store"), "w")
    assert sum(f.stat().st_size for f in files(tmp_path / "store")) < 4_000_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        M.write_postings(rows, str(tmp_path / "plain"), "w")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(files(tmp_path / "plain")) <= M.STORE_BUCKETS and len(stored(spark, str(tmp_path / "plain"))) == 640
