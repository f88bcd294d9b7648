"""Memory tables keep one state for every reader, whatever is written or folded meanwhile."""

import threading

import __spark_entry__ as entry
from check_oracle import compare, connect
from jobsieve.schema import HISTORY
from jobsieve.sources import memory as M
from jobsieve.sources import snapshots
from pyspark.sql import functions as F


def rows(spark, *xs):
    return spark.createDataFrame(list(xs), "job_id string, t string").select("job_id", F.to_timestamp("t").alias("exported_at"))


def read(spark, path, version=None):
    return {r.job_id: str(r.exported_at)[:10] for r in M.read_memory(spark, path, HISTORY, "job_id", "exported_at", version).collect()}


def fold(spark, path):
    return M.fold_memory(spark, path, HISTORY, "job_id", "exported_at")


def test_query_equals_sql(spark, small):
    for name in ("history_folded", "stream_verdicts"):
        assert compare(spark, connect(small), entry.queries()[name], entry.oracle_sql()[name], small) is None


def test_readers_keep_their_state(spark, tmp_path):
    path = str(tmp_path / "history")
    assert read(spark, path) == {}
    M.upsert_memory(rows(spark, ("a", "2024-01-01"), ("b", "2024-01-01")), path)
    pinned = M.read_memory(spark, path, HISTORY, "job_id", "exported_at")
    M.upsert_memory(rows(spark, ("a", "2024-02-01"), ("c", "2024-02-01")), path)
    M.forget(spark.createDataFrame([("b",)], "job_id string"), path, HISTORY, "job_id", "exported_at", "2024-03-01")
    after = {"a": "2024-02-01", "c": "2024-02-01"}
    assert read(spark, path) == after and {r.job_id for r in pinned.collect()} == {"a", "b"}
    assert fold(spark, path) and read(spark, path) == after and not fold(spark, path)
    assert {r.job_id for r in pinned.collect()} == {"a", "b"} and read(spark, path, 1) == {"a": "2024-01-01", "b": "2024-01-01"}
    # An older row that comes after the folding stays behind its tombstone.
    M.upsert_memory(rows(spark, ("b", "2024-02-15"), ("d", "2024-01-01")), path)
    assert read(spark, path) == after | {"d": "2024-01-01"}


def test_unfinished_writes_are_not_read(spark, tmp_path):
    path = str(tmp_path / "history")
    M.upsert_memory(rows(spark, ("a", "2024-01-01")), path)
    rows(spark, ("z", "2024-01-01")).withColumn("_deleted", F.lit(False)).write.parquet(f"{path}/stray")
    assert read(spark, path) == {"a": "2024-01-01"}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    for batch, day in ((0, "01"), (1, "02"), (1, "03"), (0, "04")):
        M.upsert_memory(rows(spark, ("a", f"2024-01-{day}")), path, "stream", batch)
    assert read(spark, path) == {"a": "2024-01-02"} and snapshots.current(spark, path).version == 2
    fold(spark, path)
    M.upsert_memory(rows(spark, ("a", "2024-01-05")), path, "stream", 1)
    M.upsert_memory(rows(spark, ("b", "2024-01-05")), path, "other", 0)
    assert read(spark, path) == {"a": "2024-01-02", "b": "2024-01-05"}


def test_lost_races_try_again(spark, tmp_path):
    path = str(tmp_path / "history")
    M.upsert_memory(rows(spark, ("x", "2024-01-01")), path)
    writers = [threading.Thread(target=M.upsert_memory, args=(rows(spark, (f"w{i}", "2024-01-01")), path)) for i in range(5)]
    folder = threading.Thread(target=fold, args=(spark, path))
    for t in (*writers, folder):
        t.start()
    for t in (*writers, folder):
        t.join()
    assert set(read(spark, path)) == {"x", *(f"w{i}" for i in range(5))}


def test_second_folding_of_the_same_writes_is_left_out(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    for i in range(3):
        M.upsert_memory(rows(spark, (f"k{i}", "2024-01-01")), path)
    real, done = snapshots.commit, []

    def slow(s, p, change):
        if not done:
            done.append(1)
            monkeypatch.setattr(snapshots, "commit", real)
            assert fold(s, p)  # another folding and a write come first
            M.upsert_memory(rows(s, ("k9", "2024-01-01")), p)
        return real(s, p, change)

    monkeypatch.setattr(snapshots, "commit", slow)
    assert not fold(spark, path) and set(read(spark, path)) == {"k0", "k1", "k2", "k9"}
