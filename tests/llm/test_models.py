"""Quality classifier and language model: held-out accuracy, normalisation, odd rows."""

import math
import tracemalloc
import zlib
from collections import Counter

import __spark_entry__ as entry
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from jobsieve.llm import lbl, quality
from pyspark.sql import functions as F

MIDDLE = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    got = entry.queries()["op5_quality"](spark, MIDDLE).collect()
    labels = dict(duckdb.sql(f"select doc_id, quality from '{MIDDLE}/labels.parquet'").fetchall())
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    seen = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in seen]) > 0.95
    good = [r.predicted for r in seen if labels[r.doc_id]]
    assert np.mean(good) > 0.97


def test_quality_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    model = quality.fit_quality(odd_docs, labels, F.lit(True))
    assert quality.score_quality(odd_docs.select("doc_id", "text"), model).count() == odd_docs.count()
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
    nothing = quality.fit_quality(no_docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score_quality(odd_docs.select("text"), nothing).collect()} == {0.5}
    assert quality.keep_good(no_docs, nothing).count() == 0


def test_rows_of_one_id_count_once(spark, monkeypatch):
    """Thousands of rows under one labelled id are one row for the fit, and the bound holds for rows."""
    seen = []
    train = quality.train_network
    monkeypatch.setattr(quality, "train_network", lambda x, y, v: seen.append(len(x)) or train(x, y, v, steps=5))
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(3000)] + [(i, "another text") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    quality.fit_quality(docs, labels, F.lit(True))
    quality.fit_quality(docs, labels, F.lit(True), max_rows=7)
    assert seen == [39, 7]


def test_context_vectors_count_neighbours(docs_of):
    """Words in the same surroundings get like vectors."""
    vectors = quality.word_vectors(docs_of([(i, f"the {w} sat on a mat . my {w} is big" if k else f"in {w} we trust , for {w} does so", "a")
                                            for i, (w, k) in enumerate([("cat", 1), ("dog", 1), ("law", 0), ("god", 0)])]))
    slot = lambda w: quality._term(w.encode()) & 0xFFFFFFFF
    cat, dog, law = (vectors[slot(w)] for w in ("cat", "dog", "law"))
    assert cat @ dog > 0.9 > cat @ law


def test_context_sums_in_little_memory():
    """Sums over every word of long texts are exact, and the surroundings of 250,000 words never stand in memory at once."""
    texts = [" ".join(f"w{(i * i + t) % 3001}" for i in range(n)) for t, n in enumerate([250_000, 1, 70_000, 2])]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(quality._contexts([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6
    want = np.zeros((quality.SLOTS, quality.DIM), np.int64)
    index = quality.index_vectors().astype(np.int64)
    for piece in quality.small([batch], 0):
        w, s, _ = quality._terms(piece.column(0).to_pylist(), quality.Kept(quality._term))
        own = np.pad(index[w] + index[s], ((2, 2), (0, 0)))
        around = own[:-4] + own[1:-3] + own[3:-1] + own[4:]
        np.add.at(want, w, around)
        np.add.at(want, s, around)
    rows = np.zeros_like(want)
    rows[got["slot"].to_numpy()] = np.stack([got[f"v{d}"].to_numpy() for d in range(quality.DIM)], 1)
    assert (rows == want).all()


def brute_base(rows, held):
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
            for i, t in rows}


def test_lm_base_and_gain(spark, monkeypatch):
    rows = duckdb.sql(f"select doc_id, text from '{MIDDLE}/documents.parquet'").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = brute_base(rows, held)
    monkeypatch.setattr(lbl, "KNOWN", 3000)  # so that most words meet their counts in the join
    got = entry.queries()["op7_log_bilinear"](spark, MIDDLE).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == held(r.doc_id)
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_probabilities_add_up(spark, docs_of):
    """After any two words the probabilities of all known words, the end, and what is left for unknown ones are 1."""
    docs = docs_of([(i, f"a b c{i % 7} d. e{i % 5} ab cd", "s") for i in range(60)])
    model = lbl.fit_lm(docs)
    words = [bytes(r.word) for r in model.counts.collect()]
    own = {w for w, i in model.slots.index.items() if model.slots.slot[i] <= lbl.OWN}
    texts = docs_of([(k, f"a b {w.decode()}" if w else "a b", "s") for k, w in enumerate(words)] + [(-1, "a b zzunknownzz", "s"), (-2, "a", "s"), (-3, "", "s")])
    score = {r.doc_id: r.score for r in lbl.score_lm(texts, model).collect()}
    net, z = model.network, model.normalisers
    slots = np.exp(net.context[5] @ net.first @ net.target.T + net.context[9] @ net.second @ net.target.T + net.bias - z[5, 9])
    assert slots.sum() == pytest.approx(1, abs=1e-4)
    within = Counter()
    for w in words:
        i = model.slots.index[w]
        s = int(model.slots.slot[i])
        within[s] += 1 if w in own or w == b"" else (model.slots.count[i] + 0.5) / (model.slots.slot_count[s] + 0.5 * (model.slots.slot_words[s] + 1))
    left = lambda s: 0.5 / (model.slots.slot_count[s] + 0.5 * (model.slots.slot_words[s] + 1)) if s > lbl.OWN else 0
    assert all(v + left(s) == pytest.approx(1) for s, v in within.items())
    assert all(v < 0 for v in score.values())


def test_lm_on_odd_rows(odd_docs, no_docs):
    got = lbl.score_lm(odd_docs, lbl.fit_lm(odd_docs)).collect()
    assert len(got) == odd_docs.count() and all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (5, 6)} == {1}
    untrained = lbl.score_lm(odd_docs, lbl.fit_lm(no_docs)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0, abs=1e-6) and r.score < 0 for r in untrained)
    assert lbl.score_lm(no_docs, lbl.fit_lm(odd_docs)).count() == 0
