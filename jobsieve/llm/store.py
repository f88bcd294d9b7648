"""Shared-folder tables and files for operators that must cut lineage or write their own formats."""

from __future__ import annotations

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.session import scratch

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    What follows can be recomputed from those files when an executor is lost, and two readers see the same rows.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(docs: DataFrame, into: str = "_row") -> DataFrame:
    """``docs`` with a text that tells each row from all others, also from equal ones, and is the same at every reading.

    Rows read from files have their file and place; others are written first.
    """
    if into in docs.columns:
        raise ValueError(f"the table has a column {into} of its own")
    try:
        return docs.select("*", F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias(into))
    except AnalysisException:
        return stored(docs.withColumn(into, F.monotonically_increasing_id().cast("string")), "rows")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for files that tasks write themselves."""
    path = scratch(spark, name)
    files, root = open_fs(path)
    files.create_dir(root, recursive=True)
    return path


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI; a path without a scheme is local, as in tests."""
    return fs.FileSystem.from_uri(path)


def count_words(text: Column | str) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")
