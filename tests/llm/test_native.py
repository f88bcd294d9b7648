"""Exact dedup, mixing and perspectives: brute force on odd rows, and the registered queries against SQL."""

import hashlib
import random
import re

import __spark_entry__ as entry
import duckdb
import pytest
from check_oracle import compare, connect
from jobsieve.llm import exact_dedup, fair_mix, perspectives


@pytest.mark.parametrize("name", ["op1_chunk_recipes", "op3_fair_mix", "op6_winnowing", "op10_perspectives"])
def test_query_equals_sql(spark, small, name):
    assert compare(spark, connect(small), entry.queries()[name], entry.oracle_sql()[name], small) is None


def test_exact_dedup_on_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t), i is None, i))
    got = exact_dedup.exact_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), str(min(groups[norm(t)], key=lambda x: (x[0], x[1], x[2] or 0))[2]), len(groups[norm(t)]),
                   hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)


def test_chunks_follow_content(docs_of):
    text = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    found = exact_dedup.recipes(docs_of([(1, text, "a"), (2, "zzz" + text, "a")])).collect()
    a, b = ({c.id for c in r.recipe} for r in found)
    assert len(a) > 5 and len(a & b) >= len(a) - 3


def test_shared_identifiers_are_told_apart(spark):
    rows = [(1, 1, 10, "h", [(7, 4, bytearray(b"x"))]), (2, 2, 10, "h", [(7, 4, bytearray(b"y"))]), (3, 3, 10, "h", [(7, 4, bytearray(b"x"))])]
    found = spark.createDataFrame(rows, "uid long, doc_id long, points long, text_sha256 string, recipe array<struct<id:bigint,size:int,proof:binary>>")
    lists = {r.doc_id: (r.ids, r.clashes) for r in exact_dedup.verified_lists(found).collect()}
    assert lists[1] == lists[3] != lists[2]


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def shares(sizes, weights, budget):
    """Excess over the caps is dealt out again until none is above."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = budget - sum(target[s] for s in sizes if s not in open_)
        for s in open_:
            target[s] = left * weights[s] / sum(weights[x] for x in open_)
        over = {s for s in open_ if target[s] >= 2 * sizes[s]}
        for s in over:
            target[s] = 2.0 * sizes[s]
        if not over:
            break
        open_ -= over
    return target


def test_mix_on_odd_rows(odd_docs):
    got = fair_mix.mix_plan(odd_docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in odd_docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = shares(sizes, weights, 1.5 * sum(sizes.values()))
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in own)
        assert sum(r.taken for r in own) == int(want[s] + 1e-9)
    assert all(0 <= r.taken <= 2 * r.size for r in got) and len(got) == odd_docs.count()
    again = fair_mix.mix_plan(odd_docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_stream_is_in_order_of_finish(odd_docs, no_docs):
    sent = fair_mix.mix_stream(odd_docs).collect()
    assert [r.finish for r in sent] == sorted(r.finish for r in sent) and sent
    assert fair_mix.mix_stream(no_docs).count() == 0


CHAT = "conv_id bigint, turn bigint, role string, text string, messages string"


def render(rows, segment=perspectives.SEGMENT):
    convs = {}
    for c, t, r, x in rows:
        name = re.sub(r"[\s<>|]+", "_", (r or "").strip(" ")) or "unknown"
        convs.setdefault(c, []).append((t is not None, t or 0, name, (x or "").replace("<|", "< |")))
    out = []
    for c, ms in convs.items():
        ms.sort()
        for k in range(0, len(ms), segment):
            part = ms[k: k + segment]
            for who in sorted({m[2] for m in part} - {"system"}):
                text, mask = "", []
                for _, _, name, x in part:
                    role = "system" if name == "system" else "assistant" if name == who else f"user name={name}"
                    text += f"<|im_start|>{role}\n"
                    if name == who:
                        mask.append((len(text), len(text) + len(x) + 10))
                    text += x + "<|im_end|>\n"
                out.append((str(c), k // segment, who, text, str(mask)))
    return sorted(out)


def test_perspectives_on_odd_rows(spark):
    rows = [(1, 0, "system", "Be kind <|im_start|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "cy", "a\nb"), (1, 3, "cy", "a\nb"), (1, None, "ann", "é𝄞"),
            (2, 1, None, "x"), (2, 1, " ", "y"), (3, 0, "system", "alone"), (None, 0, "ann", "lost")] + [(4, i, f"p{i % 3}", f"m{i}") for i in range(150)]
    df = spark.createDataFrame([(*r, "own") for r in rows], CHAT)
    got = perspectives.rotate(df).collect()
    assert sorted((str(r.conv_id), r.segment, r.perspective, r.rendered, str([tuple(m) for m in r.mask])) for r in got) == render(rows)
    for r in got:
        assert all(r.rendered[a:b].endswith("<|im_end|>") for a, b in r.mask) and len(r.mask) == r.n_trained
    assert perspectives.rotate(df.where("false")).count() == 0


def test_perspectives_of_a_long_conversation_are_whole(spark):
    """Chunks joined in order are one rendering for every participant, also one who is silent in most of them."""
    rows = [(1, 0, "system", "Be kind")] + [(1, i, "ann" if i == 3 else "late" if i == 149 else f"p{i % 2}", f"m{i}") for i in range(1, 150)]
    rows += [(None, i, "system" if i < 70 else "bo", "é𝄞") for i in range(80)] + [(2, 0, "ann", "hi")]
    want = {(c, who): (text, mask) for c, _, who, text, mask in render(rows, 1000)}
    got = {}
    for r in perspectives.rotate(spark.createDataFrame([(*r, "own") for r in rows], CHAT)).collect():
        got.setdefault((str(r.conv_id), r.perspective), []).append(r)
    assert got.keys() == want.keys()
    for key, chunks in got.items():
        chunks.sort(key=lambda r: r.segment)
        assert [r.segment for r in chunks] == list(range(len(chunks))) and all(r.n_messages <= 64 for r in chunks)
        text = "".join(r.rendered for r in chunks)
        assert [r.offset for r in chunks] == [sum(len(x.rendered) for x in chunks[:k]) for k in range(len(chunks))]
        assert (text, str([(r.offset + a, r.offset + b) for r in chunks for a, b in r.mask])) == want[key]


@pytest.mark.parametrize("messages", [70, 150])
def test_sql_of_long_conversations(spark, tmp_path, messages):
    """Beyond one chunk the registered query and its SQL still agree, with speakers who are silent in most chunks."""
    rows = [(c, i, "ann" if i == 3 else "late" if i == messages - 1 else f"p{i % 2}", f"m{i}") for c in (1, 2) for i in range(messages)] + [(3, 0, "system", "x")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert compare(spark, con, entry.queries()["op10_perspectives"], entry.oracle_sql()["op10_perspectives"], str(tmp_path)) is None


def test_no_python_in_native_plans(odd_docs, spark):
    chats = spark.createDataFrame([(1, 1, "a", "x", "own")], CHAT)
    for df in (exact_dedup.exact_duplicates(odd_docs), fair_mix.mix_plan(odd_docs), perspectives.rotate(chats)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
