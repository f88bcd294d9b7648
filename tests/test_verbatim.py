"""Values in texts word for word: blocks of values and an automaton against plain containment."""

import random
import re
from collections import Counter

import __spark_entry__ as entry
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from jobsieve.operators import verbatim as VB


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab é", max_size=70), max_size=30, unique=True), st.text("ab é", max_size=300))
def test_block_equals_containment(values, text):
    assert VB.Block((v, i) for i, v in enumerate(values)).held_in(text) == {i for i, v in enumerate(values) if v in text}


@pytest.mark.parametrize("block_values, block_chars, held", [(20_000, 1 << 20, 1 << 20), (3, 1 << 20, 200), (50, 100, 1)])
def test_pairs_equal_containment(spark, monkeypatch, block_values, block_chars, held):
    monkeypatch.setattr(VB, "BLOCK_VALUES", block_values)
    monkeypatch.setattr(VB, "BLOCK_CHARS", block_chars)
    monkeypatch.setattr(VB, "HELD_CHARS", held)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 3)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 80)))) for i in range(40)] + [(1, "ab ab"), (None, "abc"), (7, None), (8, ""), (9, "x" * 5000 + "long end")]
    held_values = [t[a: a + n] for _, t in texts if t for a, n in [(rng.randrange(len(t)), rng.choice([1, 3, 31, 32, 33, 90, 4000]))]]
    values = [(f"i{k}", v) for k, v in enumerate(held_values + ["", None, "zzz", "ab", "ab", "x" * 32 + "y", "x" * 40])] + [("i0", "c")]
    got = VB.find_verbatim(spark.createDataFrame(texts, "id bigint, page string"), spark.createDataFrame(values, "item string, v string"), "id", "page", "item", "v")
    want = Counter((i, k) for i, t in texts for k, v in values if t is not None and v is not None and v in t)
    assert Counter(map(tuple, got.collect())) == want


def test_many_items_with_one_beginning(spark):
    """Values that share their first 200 characters are told apart by a look-up, not one by one."""
    head = "the same beginning " * 12
    values = spark.range(30_000).selectExpr("cast(id as string) as item", f"concat('{head}', id, '.') as v")
    texts = spark.createDataFrame([(1, f"so {head}17. and {head}29999."), (2, head), (3, f"{head}170. {head}5")], "id bigint, page string")
    got = VB.find_verbatim(texts, values, "id", "page", "item", "v")
    assert sorted(map(tuple, got.collect())) == [(1, "17"), (1, "29999"), (3, "170")]


def test_nothing_to_look_for(spark):
    texts = spark.createDataFrame([(1, "a")], "id bigint, page string")
    none = spark.createDataFrame([], "item string, v string")
    assert VB.find_verbatim(texts, none, "id", "page", "item", "v").count() == 0
    assert VB.find_verbatim(texts.where("false"), spark.createDataFrame([("i", "a")], "item string, v string"), "id", "page", "item", "v").count() == 0


def test_no_cross_join(spark, small):
    plan = entry.queries()["verify_verbatim"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Cartesian|NestedLoop", plan) and plan.count("MapInArrow") == 1
