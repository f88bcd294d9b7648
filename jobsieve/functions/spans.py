"""Regex matches with their offsets, without leaving the JVM.

Spark's regexp functions return no positions, but the pieces *between* the matches (``split``) and the
matches themselves (``regexp_extract_all``) together cover the text, so offsets are running sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsieve.functions.text import col, let

SPAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("m", T.StringType()),
        ]
    )
)


DOUBLINGS = 28  # steps of the running sums: lists of up to 2**28 matches, more than a text can hold


def running_sums(sizes: Column) -> Column:
    """Running sums of an array: each step adds to every place the sum that stands 1, 2, 4, ... places before it.

    A list of m numbers takes log2(m) steps of m additions; nothing is copied per element. Bind ``sizes`` first (``let``): it is used often.
    """
    steps = F.slice(F.array(*[F.lit(1 << k) for k in range(DOUBLINGS)]), F.lit(1), F.length(F.bin(F.size(sizes).cast("long") - 1)))

    def add(sums, reach):
        return F.zip_with(sums, F.concat(F.array_repeat(F.lit(0), reach), F.slice(sums, F.lit(1), F.size(sums) - reach)), lambda u, v: u + v)

    return F.when(F.size(sizes) > 1, F.aggregate(steps, sizes, add)).otherwise(sizes)


def find_spans(text: Column | str, pattern: str, only_if: str | None = None, keep: str | None = None) -> Column:
    """All non-empty matches of ``pattern`` as ``array<struct<start,end,m>>`` (zero-based, end exclusive).

    ``only_if`` is a cheap test that every text with a useful match passes; the rest skip both scans.
    ``keep`` drops matches that do not contain it. Groups are read back from ``m`` with ``regexp_extract``.
    """
    t = col(text)
    empty = F.from_json(F.lit("[]"), SPAN)
    pairs = F.filter(F.zip_with(
        F.split(t, pattern, -1),
        F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct((F.length(gap) + F.length(m)).alias("size"), m.alias("m")),
    ), lambda p: p["m"].isNotNull())

    def spans(found):
        ends = let(F.transform(found, lambda p: p["size"]), running_sums)
        every = F.zip_with(ends, found, lambda end, p: F.struct((end - F.length(p["m"])).cast("int").alias("start"), end.cast("int").alias("end"), p["m"].alias("m")))
        return F.filter(every, lambda s: s["m"].rlike(keep)) if keep else every

    # Most texts have no match: they skip the sums.
    walked = let(pairs, lambda found: F.when(F.size(found) == 0, empty).otherwise(spans(found)))
    return F.when(t.rlike(only_if), walked).otherwise(empty) if only_if else walked


def first_start(text: Column | str, pattern: str) -> Column:
    """Offset of the first match (the length of what precedes it)."""
    return F.length(F.get(F.split(col(text), pattern, 2), F.lit(0)))
