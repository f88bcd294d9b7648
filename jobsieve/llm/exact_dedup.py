"""Exact duplicates by content-defined chunk recipes.

A text, without its ASCII white space, is cut where its own content says so. Every chunk becomes a 64-bit
identifier; a chunk is *verified* by its length and SHA-256, and identifiers that two different chunks share are told
apart by an ordinal. Texts are equal when their ordered identifier lists are equal. Only 44 bytes per chunk are ever
moved: no document text crosses an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.llm.store import SPACES, stored

MIN_CHUNK = 256
MAX_CHUNK = 8192
# Nine characters in a row of one half of the letters and digits: about one place in 500 in running text. All
# characters beyond ASCII belong to the half, so other scripts are cut at the smallest size.
BOUNDARY = r"[a-mA-M0-4[^\x00-\x7F]]{9}"


def chunk_pattern(smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> str:
    """One chunk: up to the first boundary past ``smallest`` characters, or ``largest``, or the rest."""
    return rf"(?s).{{{smallest},{largest}}}?{BOUNDARY}|(?s).{{1,{largest}}}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> DataFrame:
    """``(uid, doc_id, points, text_sha256, recipe)`` per row, stored; recipe holds ``(id, size, proof)`` in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("points"),
                      F.regexp_replace(text, SPACES, "").alias("norm"))
    cut = cut.select("doc_id", "points", F.sha2("norm", 256).alias("text_sha256"),
                     F.regexp_extract_all("norm", F.lit(chunk_pattern(smallest, largest)), F.lit(0)).alias("chunks"))
    recipe = F.transform("chunks", lambda c: F.struct(
        F.xxhash64(c).alias("id"), F.octet_length(c).alias("size"), F.unhex(F.sha2(c, 256)).alias("proof")))
    return stored(cut.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "points", "text_sha256",
                             recipe.alias("recipe")), "recipes")


def chunk_table(found: DataFrame) -> DataFrame:
    """Distinct chunks ``(id, size, proof, n_uses)``; copies are combined before the shuffle."""
    return (found.select(F.explode("recipe").alias("c")).select("c.*")
            .groupBy("id", "size", "proof").agg(F.count(F.lit(1)).alias("n_uses")))


def verified_lists(found: DataFrame) -> DataFrame:
    """``found`` with ``ids`` and ``clashes``: the ordered identifiers, and ``(pos, ordinal)`` where an identifier
    stands for several different chunks. Almost always no identifier does, and the joins below are over nothing."""
    chunks = chunk_table(found)
    shared = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    ordinal = F.row_number().over(Window.partitionBy("id").orderBy("size", "proof"))
    told = stored(chunks.join(shared, "id", "left_semi").select("id", "size", "proof", ordinal.alias("ordinal")), "clashes")
    places = (found.select("uid", F.posexplode("recipe").alias("pos", "c")).select("uid", "pos", "c.*")
              .join(told, ["id", "size", "proof"])
              .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "ordinal"))).alias("clashes")))
    none = F.array().cast("array<struct<pos:int,ordinal:int>>")
    return (found.join(places, "uid", "left")
            .select("uid", "doc_id", "points", "text_sha256", F.col("recipe.id").alias("ids"),
                    F.coalesce("clashes", none).alias("clashes")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``.

    Of equal texts the row with the most code points stays, then the smallest ``doc_id`` (null last). Exactly one row
    of a group is kept, also when whole rows repeat. Null text is empty; empty texts form one group; extra columns are
    ignored; an empty table gives none.
    """
    lists = verified_lists(recipes(docs, id_col, text_col, smallest, largest))
    key = F.xxhash64("ids", "clashes")  # a cheap first sort key; the lists themselves decide
    lists = lists.withColumn("list_hash", key)
    order = F.struct((-F.col("points")).alias("p"), F.isnull("doc_id").alias("null_id"), "doc_id", "uid")
    groups = stored(
        lists.groupBy("list_hash", "ids", "clashes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("list_hash", "ids", "clashes", F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"),
                "group_size"), "equal-texts")
    # Both sides are plain tables, so that adaptive execution can split a group with many copies.
    return lists.join(groups, ["list_hash", "ids", "clashes"], "left").select(
        "doc_id",
        F.when(F.isnull("group_size"), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        "text_sha256", F.size("ids").alias("n_chunks"))
