"""Every stage of the pipeline against what its operator says, and on odd rows."""

import corpus_pipeline as pipeline
import pytest
from jobsieve.llm.store import stored
from pyspark.sql import functions as F

from test_search import brute_components, brute_hits


@pytest.fixture(scope="module")
def staged(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, small), name)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(staged):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
    assert all(staged[n].columns == staged["documents"].columns for n in names[:-1])


def test_one_of_each_group_stays(staged):
    before = rows(staged["quality"])
    groups = {c for _, n, c in brute_components(before) if n}
    wordless = sum(n == 0 for _, n, _ in brute_components(before))
    assert {str(i) for i, _ in rows(staged["near_duplicates"])} >= groups
    assert staged["near_duplicates"].count() == len(groups) + wordless


def test_contaminated_documents_go(spark, small, staged):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = sorted(i for i, _, hits, _ in brute_hits(rows(staged["near_duplicates"]), items) if not hits)
    assert sorted(str(i) for i, _ in rows(staged["decontamination"])) == want


def test_mix_is_near_its_targets(staged):
    words = lambda df: sum(len((t or "").split()) for _, t in rows(df))
    total = words(staged["decontamination"])
    assert abs(words(staged["mixing"]) - 1.5 * total) < 0.15 * total
    assert {i for i, _ in rows(staged["mixing"])} <= {i for i, _ in rows(staged["decontamination"])}
    assert staged["token_files"].count() == staged["mixing"].count()


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_on_odd_rows(spark, small, odd_docs, no_docs, stage):
    out = stage(spark, odd_docs, small)
    assert out.count() >= 1
    assert stage(spark, no_docs, small).count() == 0
    if stage is not pipeline.write_tokens:
        assert out.columns == odd_docs.columns
    if stage is pipeline.keep_distinct:
        kept = [r.doc_id for r in out.collect()]
        assert sorted(map(str, kept)) == sorted(["1", "None", "5", "6", "7", "9", "12", "12", "13"])


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[1:]], ids=[n for n, _ in pipeline.STAGES[1:]])
def test_stages_on_clashing_names(spark, small, odd_docs, stage):
    """Columns named as the stages name their own change nothing."""
    names = ["_row", "_row_", "_times", "_time", "row", "size", "queue", "of", "key", "_metadata"]
    own = odd_docs.drop("key").select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    out = stage(spark, own, small)
    assert out.count() == stage(spark, odd_docs, small).count()
    if stage is not pipeline.write_tokens:
        assert out.columns == own.columns and {r["_times"] for r in out.collect()} == {"own _times"}
