"""Language labels, spelling variants and importance resampling: brute force, held-out accuracy, odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import __spark_entry__ as entry
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from check_oracle import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from jobsieve.llm import byte_spans, importance, language_crf, spelling_trie
from pyspark.sql import functions as F

MIDDLE = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", ["op12_spelling_trie", "op13_importance"])
def test_query_equals_sql(spark, small, name):
    assert compare(spark, connect(small), entry.queries()[name], entry.oracle_sql()[name], small) is None


# Spans and their CRC-32

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB9é日 -\t", max_size=300)), max_size=12), st.integers(1, 3))
def test_spans_and_sums_equal_the_plain_library(texts, n):
    data, offsets = byte_spans.text_bytes(pa.array(texts, pa.string()))
    data = byte_spans.LOWER[data]
    starts, ends, firsts = byte_spans.word_spans(data, offsets)
    words = [[w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))] for t in texts]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [w for ws in words for w in ws]
    joined, starts, ends = byte_spans.joined_words(data, starts, ends, firsts)
    a, b, heads = byte_spans.gram_spans(starts, ends, firsts, n)
    grams = [[b" ".join(ws[i: i + n]) for i in range(len(ws) - n + 1)] for ws in words]
    assert np.diff(heads).tolist() == [len(g) for g in grams]
    assert byte_spans.span_crc32(joined, a, b).tolist() == [zlib.crc32(x) for g in grams for x in g]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 127, 128, 129, 4096, 4097, 1_000_003])
def test_long_spans_fold(size):
    data = np.frombuffer(np.random.default_rng(size).bytes(size + 7), np.uint8)
    got = byte_spans.span_crc32(data, np.array([3, 0]), np.array([3 + size, 5]))
    assert got.tolist() == [zlib.crc32(data[3: 3 + size].tobytes()), zlib.crc32(data[:5].tobytes())]


# Importance resampling

def brute_resample(docs, target, n_max=1, buckets=importance.BUCKETS):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    runs = lambda ws: [zlib.crc32(" ".join(ws[i: i + n]).encode()) % buckets for n in range(1, n_max + 1) for i in range(len(ws) - n + 1)]
    feats = lambda t: runs(words(t))
    s, t = Counter(f for _, x in docs for f in feats(x)), Counter(f for x in target for f in feats(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda f: math.floor(1000 * math.log((t[f] + 1) * (big_s + buckets) / ((s[f] + 1) * (big_t + buckets))))
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(f) for f in feats(x))
        out.append((i, len(words(x)), len(feats(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    drawn = order[: 10 * len(order) // 100]
    return Counter([(*r, k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in order[len(drawn):]] + [(*r, None) for r in out if r[1] < 20])


@pytest.mark.parametrize("n_max", [1, 3])
def test_resample_equals_brute_force(spark, odd_docs, docs_of, n_max):
    more = docs_of([(100 + i % 37, " ".join(f"w{(i * k) % 11}" for k in range(i)), "m") for i in range(60)])
    docs = odd_docs.union(more)
    target = spark.createDataFrame([("w1 w2 w3 w4 w1 fox", 1), (None, 2), ("", 3), ("word1x1 " + "z" * 500, 4)], "text string, rank int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_resample(rows, ["w1 w2 w3 w4 w1 fox", None, "", "word1x1 " + "z" * 500], n_max)
    got = importance.resample(docs, target, n_max=n_max)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_resample_of_copies_and_nothing(spark, docs_of, no_docs):
    text = " ".join(f"word{i}" for i in range(30))
    copies = docs_of([(7, text, "a")] * 400 + [(i, text, "b") for i in range(200)])
    got = importance.resample(copies, no_docs).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 61)) and len({r.score for r in got if r.doc_id == 7}) == 1
    assert importance.resample(no_docs, copies).count() == 0


# Spelling variants

def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:] and len(b) == len(a) + 1)


def brute_variants(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def variants_of(spark, counts):
    got = spelling_trie.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()}


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    counts = {}
    for _ in range(700):
        counts["".join(rng.choice(list("abé"), rng.choice([5, 5, 6, 6, 7, 8, 9, 12])))] = int(rng.choice([3, 3, 4, 6, 7, 12, 30, 100]))
    assert variants_of(spark, counts) == brute_variants(counts)


def test_variants_of_long_words(spark):
    """Around and beyond the longest word of the trie, edits stand at every place, also in runs of one character."""
    counts, base = {}, "abcd" * 60
    for size in (30, 63, 64, 65, 66, 200):
        w = base[:size]
        for k, s in enumerate((w, w[:-1] + "z", w[: size // 2] + "q" + w[size // 2:], w[: size // 3] + w[size // 3 + 1:], "x" + w, "é" * size)):
            counts[s] = 3 + 3 * k
    assert variants_of(spark, counts) == brute_variants(counts)


def test_variants_of_a_few_words_and_none(spark):
    assert variants_of(spark, {"colour": 10}) == {"colour": (None, "colour", 10, 0, None)}
    # Chains of forms, and ties that go to the smaller word.
    counts = {"colour": 40, "color": 20, "colr": 10, "coler": 10, "cole": 5, "zzzzz": 8, "azzzz": 4, "bzzzz": 4, "zzzz": 2}
    assert variants_of(spark, counts) == brute_variants(counts)
    assert spelling_trie.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def brute_counts(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def test_counts_on_odd_rows(odd_docs, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows_and = [(20 + i, "Größe façade naïve×÷ Ābcdef ABCÀÉ " * (i % 3) + "y" * 9) for i in range(40)]
    docs = odd_docs.unionByName(odd_docs.sparkSession.createDataFrame([(i, t, "de", "s", 1, "own", "own") for i, t in rows_and], odd_docs.schema))
    monkeypatch.setattr(spelling_trie, "HELD_WORDS", 7)
    got = spelling_trie.word_counts(docs)
    assert {r.word: r.n for r in got.collect()} == brute_counts(rows + rows_and)
    assert spelling_trie.word_counts(no_docs).count() == 0


def test_only_possible_goals_stay(spark):
    """What is left after the edit is in proportion to the pairs, not to the trie's branches."""
    rows = duckdb.sql(f"select text from '{MIDDLE}/documents.parquet'").fetchall()
    counts = brute_counts([(None, t) for (t,) in rows])
    words = spark.createDataFrame([(w,) for w in counts], "word string")
    edges = spelling_trie.edge_table(words)
    states = spelling_trie.first_edits(words, edges).count()
    pairs = spelling_trie.trie_pairs(words).count()
    assert pairs <= states <= 6 * pairs + 1000


# Language labels

def plain_marginals(scores, moves):
    n, k = scores.shape
    step, forward, back = np.exp(moves), np.zeros((n, k)), np.zeros((n, k))
    a, b = np.full(k, 1 / k), np.ones(k)
    for t in range(n):
        a = a @ step * np.exp(scores[t])
        a /= a.sum()
        forward[t] = a
    for t in reversed(range(n)):
        back[t] = b
        b = step @ (np.exp(scores[t]) * b)
        b /= b.sum()
    out = forward * back
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_chunked_chain_equals_the_plain_one(k):
    rng = np.random.default_rng(k)
    lengths = [0, 1, 5, 0, 200, 63, 64, 65, 128, 1000, 3, 0]
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    scores, moves = rng.normal(0, 3, (firsts[-1], k)), rng.normal(0, 2, (k, k))
    got = language_crf.marginals(scores, firsts, moves)
    for a, b in zip(firsts, firsts[1:], strict=False):
        assert np.allclose(got[a:b], plain_marginals(scores[a:b], moves), atol=1e-9)


def test_transition_counts_equal_all_paths():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(0, 1, (4, 3)), rng.normal(0, 1, (3, 3))
    want, total = np.zeros((3, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(np.logaddexp.reduce(moves[:, path[0]]) + sum(scores[t, x] for t, x in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for a, b in zip(path, path[1:], strict=False):
            want[a, b] += w
    got = language_crf._pair_sums(scores, np.array([0, 4]), moves)[1]
    assert np.allclose(got, want / total)


def test_held_out_languages(spark):
    got = entry.queries()["op11_language_crf"](spark, MIDDLE).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{MIDDLE}/documents.parquet'").fetchall())
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_labels_follow_a_switch(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language_crf.fit_languages(docs, F.col("doc_id") % 5 != 0)
    parts = {x: [" ".join(t.split()[:30]) for (t,) in duckdb.sql(f"select text from '{MIDDLE}/documents.parquet' where lang = '{x}' and doc_id % 5 = 0 and n_chars > 600 order by doc_id limit 10").fetchall()]
             for x in ("en", "fr", "de")}
    rows = [(i, f"{a}\n{b} {c}", len(a), len(a) + 1 + len(b)) for i, (a, b, c) in enumerate(zip(parts["en"], parts["fr"], parts["de"], strict=True))]
    got = {r.doc_id: r.runs for r in language_crf.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, a int, b int"), model, runs=True).collect()}
    right = total = 0
    for i, text, a, b in rows:
        assert all(text[r.start].isalpha() and r.start < r.end <= len(text) for r in got[i])
        for lang, lo, hi in (("en", 0, a), ("fr", a + 1, b), ("de", b + 1, len(text))):
            right += sum(max(0, min(hi, r.end) - max(lo, r.start)) for r in got[i] if r.lang == lang)
            total += hi - lo
    assert right / total > 0.9


def test_languages_on_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") == 10, None).when(F.col("doc_id") == 13, "ja").otherwise(F.col("lang")))
    model = language_crf.fit_languages(docs, F.lit(True))
    assert model.langs == ["en", "ja"]
    got = language_crf.predict_languages(docs, model, runs=True).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert all((r.lang_pred, r.score, r.runs) == ("und", 0.0, []) for r in got if r.doc_id in (5, 6) or r.doc_id is None and not r.runs)
    assert {r.lang_pred for r in got if r.doc_id == 13} == {"ja"} and {r.lang_pred for r in got if r.doc_id in (1, 2, 9)} == {"en"}
    marks = spark.createDataFrame([(1, "12 — 3.5 …"), (2, None), (3, "ß")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_crf.predict_languages(marks, model).orderBy("doc_id").collect()] == [True, True, False]
    nothing = language_crf.fit_languages(no_docs, F.lit(True))
    assert {(r.lang_pred, r.score) for r in language_crf.predict_languages(odd_docs, nothing, runs=True).collect()} == {("und", 0.0)}
    assert language_crf.predict_languages(no_docs, model).count() == 0


def test_sample_is_bounded_and_even(spark, monkeypatch):
    """A third of the rows are one text; one language is rare. The bound holds and both languages have segments."""
    seen = {}
    monkeypatch.setattr(language_crf, "train_chain", lambda segments, langs, counts: seen.update(n=Counter(langs[x] for x, _ in segments), counts=counts))
    rows = [(1, "the same text again", "en")] * 2000 + [(i, f"some words of text {i}", "en") for i in range(4000)] + [(i, f"ein text mit {i}", "de") for i in range(30)]
    language_crf.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), max_segments=100)
    assert seen["n"]["en"] <= 50 and 20 <= seen["n"]["de"] <= 50
    assert seen["counts"].sum() == 2000 * 4 + 4000 * 4 + 30 * 3
