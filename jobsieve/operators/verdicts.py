"""Reading accept/reject decisions back out of chat text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.regex import rx
from jobsieve.functions.text import trim_all

# ---- Fixed values: the shapes a decision line may take ----
_ID = r"(?=[A-Za-z0-9_]*\d)[A-Za-z0-9_]{4,64}"
_SEP = "[:\\-–—,]"
_ACCEPT = "(?:accept|approve|pursue)"
_REJECT = "(?:reject|pass on|pass|skip)"
STRICT = rx(r"^{S}*VERDICT{S}+{B}(" + _ID + r"){B}{S}+(ACCEPT|REJECT){B}{S}*" + _SEP + r"?{S}*(.*)$", True)
ID_FIRST = rx(
    r"^{S}*#?{B}(" + _ID + r"){B}{S}*" + _SEP + r"{S}*(" + _ACCEPT + "|" + _REJECT + r"){B}{S}*" + _SEP
    + r"?{S}*(.*)$", True)
VERB_FIRST = rx(
    r"^{S}*(" + _ACCEPT + "|" + _REJECT + r"){B}{S}*(?:on{S}+)?" + _SEP + r"?{S}*#?{B}(" + _ID + r"){B}{S}*"
    + _SEP + r"?{S}*(.*)$", True)
HAS_ID = rx("{B}" + _ID + "{B}")
HAS_VERB = rx("{B}(?:" + _ACCEPT + "|" + _REJECT + "){B}", True)
TOKEN = rx(r"VERDICT{S}+{NS}", True)
# ---- end of fixed values ----


def read_chat_lines(chats: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row per trimmed, non-empty line, numbered within its text."""
    keep = keep or tuple(c for c in chats.columns if c != text)
    lines = chats.select(*keep, F.posexplode_outer(F.split(F.col(text), "\r?\n")).alias("line_no", "_raw"))
    return lines.select(*keep, "line_no", trim_all("_raw").alias("line")).where("line <> ''")


def normalise_verb(verb: Column) -> Column:
    return F.when(verb.rlike("(?i)^" + _ACCEPT + "$"), "accept").otherwise("reject")


def _shape(line: Column, pattern: str, id_group: int, verb_group: int, confidence: str) -> Column:
    job_id = F.regexp_extract(line, pattern, id_group)
    return F.when(
        job_id != "",
        F.struct(
            job_id.alias("job_id"),
            normalise_verb(F.regexp_extract(line, pattern, verb_group)).alias("verdict"),
            trim_all(F.regexp_extract(line, pattern, 3)).alias("reason"),
            F.lit(confidence).alias("confidence"),
        ),
    )


def _worth_reading(line: Column) -> Column:
    # Every shape, and the ambiguous rule, needs a verb and a digit: most lines stop here.
    return line.rlike(HAS_VERB) & line.rlike("[0-9]")


def parse_verdicts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Decision lines with job_id, verdict, reason and confidence; every other column is kept."""
    c = F.col(line)
    found = F.coalesce(
        _shape(c, STRICT, 1, 2, "strict"), _shape(c, ID_FIRST, 1, 2, "loose"), _shape(c, VERB_FIRST, 2, 1, "loose")
    )
    return (
        lines.where(_worth_reading(c)).withColumn("_v", found).where("_v is not null").select(*lines.columns, "_v.*")
    )


def ambiguous_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """An id and a verb are there but in no trusted shape: shown to a human, never imported."""
    c = F.col(line)
    shaped = c.rlike(STRICT) | c.rlike(ID_FIRST) | c.rlike(VERB_FIRST)
    return lines.where(_worth_reading(c) & c.rlike(HAS_ID) & ~shaped)


def latest_verdict(
    verdicts: DataFrame, order: Sequence[str] = ("conv_id", "turn", "line_no"), per: Sequence[str] = ("job_id",)
) -> DataFrame:
    """The last line for an id wins, whatever its confidence."""
    picked = verdicts.groupBy(*per).agg(
        F.max_by(F.struct("verdict", "reason", "confidence"), F.struct(*order)).alias("_v")
    )
    return picked.select(*per, "_v.*")


def merge_verdicts(store: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(merged store, one row of added/updated/total counts)``; the batch replaces what it names.

    Both sides are unique on job_id, so the full outer join cannot fan out or skew.
    """
    old = store.select("job_id", F.struct(*[c for c in store.columns if c != "job_id"]).alias("_old"))
    new = batch.select("job_id", F.struct(*[c for c in store.columns if c != "job_id"]).alias("_new"))
    both = old.join(new, "job_id", "full_outer")
    merged = both.select("job_id", F.coalesce("_new", "_old").alias("_row")).select("job_id", "_row.*")
    counts = both.agg(
        F.count_if(F.col("_new").isNotNull() & F.col("_old").isNull()).alias("added"),
        F.count_if(F.col("_new").isNotNull() & F.col("_old").isNotNull()).alias("updated"),
        F.count(F.lit(1)).alias("total"),
    )
    return merged.select(*store.columns), counts


def verdict_token_report(lines: DataFrame, line: str = "line", first: int = 10) -> DataFrame:
    """The first lines carrying the literal token, for diagnosing a chat that yields nothing."""
    hits = lines.where(F.col(line).rlike(TOKEN))
    order = [c for c in ("conv_id", "turn", "line_no") if c in lines.columns]
    return hits.orderBy(*order).limit(first)
