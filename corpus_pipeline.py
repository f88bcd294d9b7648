"""From raw documents to token files: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept; all but the last return the
columns of ``docs``. Null ids, null texts, repeated rows, further columns and empty tables are allowed everywhere: rows are
told apart by their place in the files, never by their id. Decisions are whole: a rejected row is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.llm import count_rtree, fair_mix, quality, token_files, winnow
from jobsieve.llm.queries import bucket_of, table
from jobsieve.llm.store import stored, with_row


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels that ``op5`` learns from."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), bucket_of("of", 4) != 2)
    return quality.keep_good(docs, model)


def free(docs: DataFrame, name: str) -> str:
    """``name``, or the first longer one that is no column of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id (null last). Texts without words stay."""
    row = free(docs, "_row")
    rows = with_row(docs, row)
    ident = F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h"), F.col(row).alias("row"))
    groups = count_rtree.near_duplicates(rows.select(ident.alias("ident"), "text"), "ident")
    extra = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id.row").alias(row))
    return rows.join(extra, row, "left_anti").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window, nor a whole shorter item, with the benchmark."""
    row = free(docs, "_row")
    rows = with_row(docs, row)
    found = winnow.contamination(rows.select(row, "text"), table(spark, sf_dir, "benchmark"), doc_id=row)
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: a row for every time a document is sent, so that some stand twice and some not at all.

    Texts stay whole: of a document in service at the cut, the last sending counts if at least half its words went out.
    """
    row, times, time = free(docs, "_row"), free(docs, "_times"), free(docs, "_time")
    rows = with_row(docs, row)
    plan = fair_mix.mix_plan(rows.select("doc_id", "text", "source", row), row=F.col(row))
    sends = F.size(F.filter("epochs", lambda e: 2 * e["words"] >= F.col("size")))
    sent = plan.select(F.col("row").alias(row), sends.alias(times)).where(F.col(times) > 0)
    return rows.join(sent, row).withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(row, times, time)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in ascending id order, read back through their index: a row per document sent."""
    import public_tokenizers

    return token_files.read_token_store(token_files.write_token_store(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# A trained network decides the first stage, so SQL cannot give the rows; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
