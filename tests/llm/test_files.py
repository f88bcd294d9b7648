"""WARC archives and token files: exact round trips."""

import base64
import hashlib
import zlib

import __spark_entry__ as entry
import duckdb
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from jobsieve.llm import token_files, warc_index
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PAGE = "page_id bigint, url string, html string, digest string, ts string"


def want_records(rows, least=0):
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    return first


def test_warc_round_trip(spark, small):
    rows = duckdb.sql(f"select page_id, url, html from '{small}/pages.parquet'").fetchall()
    first = want_records(rows)
    got = sorted(map(tuple, entry.queries()["op2_warc_index"](spark, small).collect()))
    assert got == sorted((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(),
                          "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, _, h in rows)


def test_warc_on_odd_rows(spark):
    rows = [(3, "http://b.Org/x", "<p>1"), (1, "http://a.org/y\r\nX: 1", "<p>1"), (1, "http://a.org/y\r\nX: 1", "<p>1"), (2, None, None), (None, "u", None),
            (None, None, "z"), (5, "http://a.org/", "é𝄞" * 1000), (6, "http://a.org/", "é𝄞" * 1000), (7, "http://a.org/", "")]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], PAGE)
    records, index, folder = warc_index.archive(df, file_bytes=600)
    got = records.collect()
    assert len(got) == len(rows)
    first = want_records(rows)
    for h in {r[2] or "" for r in rows}:
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        own = [r for r in got if r.payload_digest == digest]
        assert len(own) == sum((r[2] or "") == h for r in rows) and {r.payload_bytes for r in own} == {len(h.encode())}
        assert [r.id for r in own if r.record_type == "response"] == [None if first[h] is None else str(first[h])]
        assert {r.refers_to for r in own if r.record_type == "revisit"} <= {None if first[h] is None else str(first[h])}
    entries = index.collect()
    order = [(e.url_key, e.ts, e.id is None, e.id or "", e["copy"]) for e in entries]
    assert order == sorted(order) and len({e.file for e in entries}) > 1
    full = warc_index.read_archives(index, folder, payloads=True).where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in full} == {r[2] or "" for r in rows}
    assert warc_index.archive(df.where("false"))[0].count() == 0


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "a", "", ""), (2, "u", "a", "", ""), (2, "u", "a", "", ""), (3, "u", "aaaa", "", ""), (4, "u", "aaaa", "", "")], PAGE)
    got = warc_index.archive(df, min_bytes=3)[0].collect()
    assert sorted((r.id, r.record_type) for r in got) == [("1", "response"), ("2", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree_merges(runs):
    got = [x[0] for x in warc_index.loser_tree([iter([(v, i) for v in sorted(r)]) for i, r in enumerate(runs)])]
    assert got == sorted(v for r in runs for v in r)


def encoded(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_rare_pieces_do_not_pile_up():
    """What a worker keeps between tasks is bounded; pieces of several batches outlive those of one, and ids stay right."""
    enc, plain = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    common = [f"often{i}" for i in range(200)]
    batches = [[" ".join([*common, *(f"b{b}x{i}" for i in range(k, k + 3000))]) for k in range(0, 30_000, 3000)] for b in range(12)]
    for b, texts in enumerate(batches):
        got = enc.encode(texts)
        assert len(enc.place) < 300_000 and len(enc.place) == len(enc.start) - 1
        if b in (0, 8, 9, 11):
            assert [g.tolist() for g in got[:2]] == [plain.encode(t, add_special_tokens=False).ids for t in texts[:2]]
    few = token_files.Encoder(PATH, cache=2000)
    for b in range(6):
        few.encode([" ".join([*common, *(f"c{b}x{i}" for i in range(900))])])
        assert b == 0 or all(f" {w}" in few.place for w in common[1:])
    assert len(few.place) < 3000
    few.encode(["plain words"])
    few.uses[:] = 2  # all of several batches, and more than may stay
    few.limit = 10
    assert few.encode(["plain words"])[0].tolist() == plain.encode("plain words", add_special_tokens=False).ids and len(few.place) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabcDE\0\u00a0$&12.,'!?1é日  \r<|", max_size=40), max_size=8))
def test_kept_pieces_change_nothing(texts):
    enc = token_files.Encoder(PATH, cache=20)
    assert [b.tolist() for b in enc.encode(texts)] == encoded(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "end", "it's", "a.b", "x,", "no-one\n", "\u2003", "\x85", "\x1c", "\0", "go.", " ", "  ", "\n", "\t", "é"]), max_size=9).map("".join), max_size=6))
def test_marks_are_encoded_as_by_the_library(texts):
    enc = token_files.Encoder(PATH, cache=20)
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [b.tolist() for b in enc.encode(texts)] == want
    assert len(enc.encode(["end <|endoftext|> go"])[0]) == 4


def test_token_files_of_a_table(spark, small):
    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet' order by 1").fetchall()
    want, start = [], 0
    for (i, _), ids in zip(rows, encoded([t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, entry.queries()["op4_token_files"](spark, small).collect())) == want


def test_token_files_on_odd_rows(odd_docs, no_docs):
    store = token_files.write_token_store(odd_docs, PATH, bucket_keys=4)
    got = token_files.read_token_store(store).collect()
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    crc = lambda ids: zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    want = sorted((str(i), len(x) + 1, crc(x)) for (i, _), x in zip(rows, encoded([t for _, t in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order)])[:-1].tolist()
    ids = [(r.doc_id is None, r.doc_id or 0) for r in in_order]
    assert ids == sorted(ids)
    keys = [r.key for r in store.manifest.collect()]
    assert len(set(keys)) == len(rows) and {"1", "3", "12", "null"} <= set(keys)
    assert token_files.read_token_store(token_files.write_token_store(no_docs, PATH)).count() == 0


def test_lookup_by_key(spark, docs_of):
    store = token_files.write_token_store(docs_of([(i, f"text number {i}", "a") for i in range(300)]), PATH, bucket_keys=50)
    wanted = spark.createDataFrame([(str(i), i) for i in range(250, 350)], "key string, mine long")
    found = store.read(store.find(wanted), payload=True).collect()
    ids = dict(zip(range(300), encoded([f"text number {i}" for i in range(300)]), strict=True))
    right = [r for r in found if r.mine < 300]
    assert len(right) == 50 and all(r.ids == [*ids[r.mine], 2] for r in right)
    assert len(found) == 50  # keys that were never stored fail the fingerprint


def test_minimal_perfect_hash():
    h = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    levels, rest = token_files.build_mph(h)
    assert not len(rest) and sorted(token_files.slots(levels, h)) == list(range(5000))
    levels, rest = token_files.build_mph(np.concatenate([h[:10], h[:3]]))
    assert len(rest) == 6 and sorted(token_files.slots(levels, h[3:10])) == list(range(7))


def test_url_key(spark):
    df = spark.createDataFrame([("http://WWW.Ex.org/A?b#c",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(warc_index.url_key(F.col("u"))).collect()] == ["org,ex,www)/A?b", "nothing", ""]
