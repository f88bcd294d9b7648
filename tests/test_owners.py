from concurrent.futures import ThreadPoolExecutor

from jobsieve.operators.dedupe import guard_duplicates
from jobsieve.sources import owners, snapshots

ROW = "job_id string, seq long, description string, owner string"


def texts(*names):
    return [f"{n} " * 120 for n in names]


def owner_of(df):
    return sorted((r.job_id or "", r.seq or 0, r.owner_id) for r in df.collect())


def batch(spark, *rows):
    return spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], ROW)


def test_batches_meet_earlier_owners(spark, tmp_path):
    path = str(tmp_path / "owners")
    a, b, c = texts("alpha", "beta", "gamma")
    one = batch(spark, ("1", 1, a), ("2", 2, a + "  "), ("3", 3, b), ("4", 4, "short"), ("4", 5, None))
    two = batch(spark, ("5", 6, b), ("6", 7, c), ("7", 8, c), ("6", 9, c), ("8", 10, "short"))
    none = one.where("false")
    assert owners.guard_batch(none, path).count() == 0 and not owners.fold_owners(spark, path)
    first = owner_of(owners.guard_batch(one, path))
    second = owner_of(owners.guard_batch(two, path))
    assert sorted(first + second) == owner_of(guard_duplicates(one.unionAll(two)))
    assert ("5", 6, "3") in second and ("2", 2, "1") in first
    # The same batch again, before and after folding, and nothing new is claimed.
    before = snapshots.current(spark, path).writes
    assert owner_of(owners.guard_batch(two, path)) == second and snapshots.current(spark, path).writes == before
    assert owners.fold_owners(spark, path) and len(snapshots.current(spark, path).writes) == 1
    assert owner_of(owners.guard_batch(one, path)) == first and owners.read_owners(spark, path).count() == 3
    assert owners.read_owners(spark, path, version=1).count() == 2


def test_ties_and_rows_without_id(spark, tmp_path):
    path = str(tmp_path / "owners")
    a, b = texts("alpha", "beta")
    got = owner_of(owners.guard_batch(batch(spark, (None, 1, a), ("2", 2, a), ("9", None, b), ("3", 7, b), ("1", 7, b)), path))
    assert got == [("", 1, None), ("1", 7, None), ("2", 2, None), ("3", 7, "1"), ("9", 0, "1")]
    # A later batch never takes a text over, however small its order.
    assert owner_of(owners.guard_batch(batch(spark, ("0", -5, b)), path)) == [("0", -5, "1")]


def test_writers_at_the_same_time_leave_one_owner(spark, tmp_path):
    path = str(tmp_path / "owners")
    shared = texts(*(f"w{i}" for i in range(30)))
    batches = [batch(spark, *((f"{k}-{i}", i, t) for i, t in enumerate(shared))) for k in range(3)]
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda df: owners.guard_batch(df, path).collect(), batches))
    kept = [r.job_id.split("-")[1] for rows in got for r in rows if r.owner_id is None]
    assert sorted(kept, key=int) == [str(i) for i in range(30)]
    known = owners.read_owners(spark, path)
    assert known.count() == 30 == known.select("digest").distinct().count()


def test_only_folders_of_the_batch_are_opened(spark, tmp_path):
    path = str(tmp_path / "owners")
    owners.guard_batch(batch(spark, *((str(i), i, t) for i, t in enumerate(texts(*(f"w{i}" for i in range(200)))))), path).count()
    whole = owners.read_owners(spark, path)
    some = owners.read_owners(spark, path, folders=[3])
    files = lambda df: {r[0] for r in df.selectExpr("_metadata.file_path").distinct().collect()}
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1][:80]
    assert 0 < some.count() < whole.count() == 200
    assert files(some) < files(whole) and all("folder=3/" in f for f in files(some))
