"""Chat formatting by multi-party perspective rotation.

For every participant the whole dialogue is rendered once with that speaker as the assistant and all others as named users;
the mask lists what the assistant says. The rendering of a conversation longer than ``segment`` messages comes in numbered
chunks, so that no row or task holds an unbounded dialogue: chunks joined in order are the rendering.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.llm.store import stored
from jobsieve.operators.ordering import number_rows

SEGMENT = 64
BLOCK = 1024  # segments in one running total
NARRATORS = ("system",)
# Fixed values of the chat layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """Layout marks inside a message are opened up, so that no message can forge a turn."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _chunks(placed: DataFrame, is_narrator: Callable[[Column], Column]) -> DataFrame:
    """``conv, segment, perspective, offset``: every participant of a conversation with every segment of it, without texts.

    A chunk's length is that of its messages as said by users, less what a shorter head spares for each of the
    participant's own. Offsets are running totals over blocks of segments and over the segments of a block.
    """
    per = stored(placed.groupBy("conv", "segment", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")), "chat-sizes")
    role = F.when(is_narrator(F.col("speaker")), F.lit(len("system"))).otherwise(F.char_length("speaker") + len("user name="))
    base = per.groupBy("conv", "segment").agg(F.sum(F.col("chars") + F.col("n") * (role + len(OPEN + CLOSE) + 2)).alias("base"))
    heard = per.where(~is_narrator(F.col("speaker")))
    sides = heard.select("conv", F.col("speaker").alias("perspective")).distinct()
    own = heard.select("conv", "segment", F.col("speaker").alias("perspective"), "n")
    spared = F.char_length("perspective") + len("user name=") - len("assistant")
    sized = stored(
        base.join(sides, "conv").join(own, ["conv", "segment", "perspective"], "left")
        .select("conv", "segment", "perspective", F.floor(F.col("segment") / BLOCK).alias("block"),
                (F.col("base") - F.coalesce("n", F.lit(0)) * spared).alias("length")), "chat-chunks")
    so_far = lambda by, order: F.coalesce(
        F.sum("length").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = ["conv", "perspective"]
    blocks = sized.groupBy(*key, "block").agg(F.sum("length").alias("length")).select(*key, "block", so_far(key, "block").alias("before"))
    return (sized.withColumn("within", so_far([*key, "block"], "segment")).join(blocks, [*key, "block"])
            .select("conv", "segment", "perspective", (F.col("before") + F.col("within")).alias("offset")))


def rotate(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", narrators: Sequence[str] = NARRATORS, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, perspective, n_messages, n_trained, rendered, mask, offset`` per conversation, segment and participant.

    Every participant has every segment of its conversation, with an empty mask where it is silent. ``mask`` is an array of
    ``(start, end)`` character offsets into ``rendered``: the assistant's words and their end mark; ``offset`` is where the
    chunk starts in the participant's whole rendering. Messages are ordered by turn (null first), then role and text;
    repeated rows are messages of their own. A null or blank role is the participant ``unknown``, null text is an empty
    message, rows without an id form one conversation. ``narrators`` keep the system role and get no perspective; a
    conversation of narrators only gives no row. Extra columns are ignored.
    """
    name = F.regexp_replace(F.trim(F.coalesce(F.col(role_col).cast("string"), F.lit(""))), r"[\s<>|]+", "_")
    said = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(name == "", F.lit("unknown")).otherwise(name).alias("speaker"),
        _safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    # A global order, not a window per conversation: one conversation may hold a third of all messages.
    numbered = number_rows(said, ["conv_id", "turn", "speaker", F.col("text")], "row_no")
    first = stored(numbered.groupBy("conv_id").agg(F.min("row_no").alias("first_no")), "chat-starts").withColumnRenamed("conv_id", "of")
    placed = (numbered.join(first, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
              .withColumn("segment", F.floor((F.col("row_no") - F.col("first_no")) / segment))
              .withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))))
    is_narrator = lambda s: s.isin(*narrators) if narrators else F.lit(False)
    chunks = _chunks(placed, is_narrator)
    parts = (placed.groupBy("conv_id", "conv", "segment")
             .agg(F.sort_array(F.collect_list(F.struct("row_no", "speaker", "text"))).alias("messages")))
    views = parts.join(chunks, ["conv", "segment"])

    def head(m: Column) -> Column:
        who = (F.when(is_narrator(m["speaker"]), F.lit("system"))
               .when(m["speaker"] == F.col("perspective"), F.lit("assistant"))
               .otherwise(F.concat(F.lit("user name="), m["speaker"])))
        return F.concat(F.lit(OPEN), who, F.lit("\n"))

    pieces = F.transform("messages", lambda m: F.struct(
        head(m).alias("head"), F.concat(m["text"], F.lit(CLOSE)).alias("body"),
        ((m["speaker"] == F.col("perspective")) & ~is_narrator(m["speaker"])).alias("trained")))
    views = views.withColumn("pieces", pieces)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate("pieces", empty, step, lambda acc: acc["spans"])
    return views.select(
        "conv_id", "segment", "perspective", F.size("pieces").alias("n_messages"),
        F.size(F.filter("pieces", lambda p: p["trained"])).alias("n_trained"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        mask.alias("mask"), "offset")
