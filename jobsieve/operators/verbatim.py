"""Which texts hold which values word for word: many values at once, each text read once.

Values are numbered and cut into blocks of bounded size, which lie as files in the shared folder. A task gathers some texts,
loads one block after the other, and runs the texts through an Aho-Corasick automaton of the beginnings of the block's values.
What stands behind a beginning is looked up among the values that share it, so that neither many values with one
beginning nor very long values cost more than a look-up for every length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.operators.ordering import number_rows
from jobsieve.session import scratch

ANCHOR = 32  # characters of a value that are in the automaton
BLOCK_VALUES = 20_000
BLOCK_CHARS = 8 << 20  # of a block's values; a longer value is a block of its own
HELD_CHARS = 16 << 20  # of the texts that a task runs through a block at once; a longer text by itself


def number_values(values: DataFrame) -> DataFrame:
    """Distinct rows of ``values(v)`` with a number ``k`` and the ``block`` they are in."""
    numbered = number_rows(values.distinct(), ["v"], "k")
    some = F.floor((F.col("k") - 1) / BLOCK_VALUES)
    before = Window.partitionBy("some").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.coalesce(F.sum(F.length("v")).over(before), F.lit(0))
    return numbered.withColumn("some", some).withColumn("part", F.floor(chars / BLOCK_CHARS)).select(
        "v", "k", F.concat_ws("-", F.col("some").cast("string"), F.col("part").cast("string")).alias("block"))


class Block:
    """The automaton of a block. ``blank``: the number of the empty value, which every text holds."""

    def __init__(self, values: Iterable[tuple[str, int]]):
        self.blank, groups = None, {}
        for v, k in values:
            if v:
                groups.setdefault(v[:ANCHOR], {}).setdefault(len(v), {})[v] = k
            else:
                self.blank = k
        self.automaton = ahocorasick.Automaton() if groups else None
        if groups:
            for start, by_length in groups.items():
                self.automaton.add_word(start, (len(start) - 1, list(by_length.items())))
            self.automaton.make_automaton()

    def held_in(self, text: str) -> set[int]:
        found = set() if self.blank is None else {self.blank}
        if self.automaton is not None:
            for end, (back, by_length) in self.automaton.iter(text):
                at = end - back
                for n, values in by_length:
                    k = values.get(text[at: at + n])
                    if k is not None:
                        found.add(k)
        return found


@lru_cache(maxsize=1)
def _load(folder: str) -> Block:
    files, root = fs.FileSystem.from_uri(folder)
    rows = pq.read_table(root, filesystem=files, columns=["v", "k"], partitioning=None)
    return Block(zip(rows["v"].to_pylist(), rows["k"].to_pylist(), strict=True))


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of rows that come to about ``HELD_CHARS``, over as many batches as that takes."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for ident, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if text is None:
                continue
            if texts and chars + len(text) > HELD_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(ident)
            texts.append(text)
            chars += len(text)
    if texts:
        yield ids, texts


def find_verbatim(texts: DataFrame, items: DataFrame, text_id: str, text: str, item_id: str, value: str) -> DataFrame:
    """``(text_id, item_id)`` for every row of ``texts`` and every row of ``items`` whose value stands anywhere in the text.

    A null text holds nothing and a null value stands nowhere; an empty value stands in every text that is not null. Repeated
    rows of either table give rows of their own. Case and white space count as they are.
    """
    spark = texts.sparkSession
    wanted = items.select(F.col(item_id).alias("item"), F.col(value).alias("v")).where("v is not null")
    numbered = number_values(wanted.select("v"))
    folder = scratch(spark, "value-blocks")
    numbered.repartition("block").write.partitionBy("block").parquet(folder)
    stored = spark.read.schema("v string, k bigint, block string").parquet(folder)
    blocks = sorted(r["block"] for r in stored.select("block").distinct().collect())  # a name for every BLOCK_VALUES values
    places = [f"{folder}/block={b}" for b in blocks]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in _gathered(batches):
            for place in places:
                block = _load(place)
                hits = [(i, k) for i, t in zip(ids, held, strict=True) for k in block.held_in(t)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i, _ in hits], hits[0][0].type), pa.array([k for _, k in hits], pa.int64())],
                                                     names=["text", "k"])

    read = texts.select(F.col(text_id).alias("text"), F.col(text).alias("page"))
    found = read.mapInArrow(scan, f"text {read.schema['text'].dataType.simpleString()}, k bigint")
    return (found.join(stored.select("v", "k"), "k").join(wanted, "v").select(F.col("text").alias(text_id), F.col("item").alias(item_id)))
