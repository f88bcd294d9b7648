"""Winnowing, URL templates and the Jaccard join against brute force."""

import random
import re

import __spark_entry__ as entry
import duckdb
import numpy as np
from jobsieve.llm import count_rtree, url_templates, winnow
from jobsieve.llm.components import components
from jobsieve.llm.queries import RULES


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items):
    out = []
    for i, t in docs:
        w, hit, met = fold(t), set(), set()
        for k, x in items:
            v = fold(x)
            n = min(10, len(v))
            for p in range(len(v) - n + 1 if v else 0):
                for q in range(len(w) - n + 1):
                    if w[q: q + n] == v[p: p + n]:
                        hit.update(range(q, q + n))
                        met.add(str(k) if k is not None else "")
        out.append((str(i), len(w), len(hit), sorted(met)))
    return sorted(out)


def test_winnowing_on_odd_rows(spark, odd_docs):
    items = [(1, "one"), (2, "QUICK brown, fox; jumps over the lazy dog while twelve other animals"), (3, None), (4, "..."), (5, "short text"), (5, "short text"),
             (None, "of four"), (6, "日本語の文章です"), (7, "word5x5 word6x6 word7x7 word8x8 word9x9 word10x10 word11x11 word12x12 word13x13 word14x14"), (8, "of it")]
    bench = spark.createDataFrame([(*i, "own") for i in items], "item_id long, text string, hits string")
    got = winnow.contamination(odd_docs, bench).collect()
    want = brute_hits([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) and sum(b - a for a, b in r.spans) == r.n_hit for r in got)
    assert winnow.contamination(odd_docs, bench.where("false")).where("contaminated").count() == 0
    assert winnow.contamination(odd_docs.where("false"), bench).count() == 0


def test_every_long_shared_span_is_found(spark, docs_of):
    rng = random.Random(3)
    words = [rng.choice("abcdefg") for _ in range(400)]
    docs = [(i, " ".join(words[i: i + rng.randint(5, 60)]), "s") for i in range(120)]
    items = [(i, " ".join(words[i * 9: i * 9 + 25])) for i in range(40)]
    got = winnow.contamination(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == brute_hits([d[:2] for d in docs], items)


def split_url(u):
    if not u or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.lower(), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def test_rules_stand(spark, small):
    urls = dict(duckdb.sql(f"select page_id, url from '{small}/pages.parquet'").fetchall())
    got = entry.queries()["op8_url_templates"](spark, small).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split_url(urls[r.page_id])
        fits = [(len(x), v, x) for v, x in RULES
                if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[2] if fits else None)
        assert r.verdict == max(fits)[1] if fits else r.verdict in ("allow", "block")


def test_templates(spark):
    """Digits and crowds become wildcards, like branches merge, and labels spread to unlabelled URLs of a template."""
    rows = []
    for i in range(200):
        rows += [(f"http://h.io/tag/{'abcdefghij'[i % 10]}{chr(97 + i // 10)}q/{i}", True), (f"http://h.io/news/{i}", False), (f"http://h.io/blog/{i}", False)]
    rows += [("http://h.io/tag/never/7", None), ("http://h.io/news/9999", None), ("http://h.io/blog", None), ("http://new.io/", None), (None, None), ("x", None), ("http://h.io/" + "a/" * 30, None)]
    df = spark.createDataFrame([(i, u, b, "own") for i, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean, template string")
    got = {r.id: r for r in url_templates.judge_urls(df, [], label=df.bad).collect()}
    assert len(got) == len(rows)
    assert got[600].verdict == "block" and got[600].template == "/tag/*/#"
    assert got[601].verdict == "allow" and got[601].template == "/{blog|news}/#"
    assert (got[604].host, got[604].path) == (got[605].host, got[605].path) == ("", "")
    assert url_templates.judge_urls(df.where("false"), RULES).count() == 0


def brute_components(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    comp = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 80 * (len(a) + len(sets[j]) - k) and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    low = {}
    for c, (i, _) in zip(comp, docs, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted((str(i), len(s), str(low.get(c))) for (i, _), s, c in zip(docs, sets, comp, strict=True))


def near(docs):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in count_rtree.near_duplicates(docs).collect())


def test_jaccard_join_on_odd_rows(odd_docs, no_docs):
    assert near(odd_docs) == brute_components([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert near(no_docs) == []


def test_jaccard_join_with_hot_passage_and_chains(docs_of):
    """A passage in every text, one large group of near copies, chains whose ends are far apart, pairs right at the bound."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    passage, docs = [word() for _ in range(30)], []
    for _ in range(60):
        docs.append(passage + [word() for _ in range(rng.randint(3, 40))])
    base = [word() for _ in range(120)]
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = word()
        docs.append(copy)
    chain = [word() for _ in range(200)]
    for step in range(30):
        docs.append(chain[step * 4: step * 4 + 80])
    for n in range(20, 60):
        x = [word() for _ in range(n)]
        docs += [x, x[: n - n // 9], x[n // 11:]]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(docs)]
    assert near(docs_of(rows)) == brute_components([r[:2] for r in rows])


def test_sets_that_share_an_id_stay_apart(docs_of, odd_docs):
    """Ids cut to two bits: nearly all sets clash, and the groups are the same."""
    rng = random.Random(4)
    rows = []
    for i in range(30):
        x = [f"w{rng.randint(0, 300)}" for _ in range(40)]
        rows += [(3 * i, " ".join(x), "s"), (3 * i + 1, " ".join([*x, "end"]), "s"), (3 * i + 2, " ".join(x[:20]), "s")]
    for docs, plain in ((docs_of(rows), [r[:2] for r in rows]), (odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()])):
        got = count_rtree.near_duplicates(docs, id_bits=2).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(plain)


def near_copies(n):
    rng = random.Random(n)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 4000))
    base, rows = [word() for _ in range(100)], []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(100)] = word()
        rows.append((i, " ".join(copy), "s"))
    return rows


def test_pairs_grow_with_a_group_of_near_copies(docs_of, monkeypatch):
    verified, plain = [], count_rtree.ShingleJoin.verify
    monkeypatch.setattr(count_rtree.ShingleJoin, "verify", lambda self, pairs: verified.append(pairs.count()) or plain(self, pairs))
    totals = {}
    for n in (200, 400, 800):
        rows = near_copies(n)
        verified.clear()
        got = near(docs_of(rows))
        if n == 200:
            assert got == brute_components([r[:2] for r in rows])
        totals[n] = sum(verified)
    assert totals[800] < 2.5 * totals[400] and totals[800] < 4 * 800


def test_texts_that_only_share_a_rare_passage_meet_no_more(docs_of, monkeypatch):
    """Pairs and threes of unlike texts with a passage in common: none is verified, none goes through the trees."""
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 100000))
    rows = []
    for k in range(60):
        passage = [word() for _ in range(30)]
        for n in (30, 60, 120)[: 2 + k % 2]:
            rows.append((len(rows), " ".join([word() for _ in range(n)] + passage + [word() for _ in range(n)]), "s"))
    verified, opened = [], []
    # A full counter table tells no shingle from another: any of the passage's may be among the rarest fifth.
    monkeypatch.setattr(count_rtree, "shingle_counters", lambda texts: np.zeros(1 << count_rtree.COUNTERS, np.uint32))
    verify, members = count_rtree.ShingleJoin.verify, count_rtree.ShingleJoin.open_members

    def noted(self, *args):
        found = members(self, *args)
        opened.append(found.count())
        return found

    monkeypatch.setattr(count_rtree.ShingleJoin, "verify", lambda self, pairs: verified.append(pairs.count()) or verify(self, pairs))
    monkeypatch.setattr(count_rtree.ShingleJoin, "open_members", noted)
    docs = docs_of(rows).repartition(4).sortWithinPartitions("doc_id")
    assert near(docs) == brute_components([r[:2] for r in rows])
    assert sum(verified) <= 2 and opened == [0]  # the first and the last bucket of a partition may go on in another one


def test_sets_leave_a_bucket_only_if_they_fit_no_other():
    rng = np.random.default_rng(5)
    lengths = np.array([2, 2, 3, 7, 32, 33, 200, 2, 64])
    starts = np.cumsum(lengths) - lengths
    n = rng.integers(5, 60, lengths.sum())
    pos = rng.integers(0, n // 5 + 1)
    live = count_rtree._live(n, 5 * n - 9 * pos, starts, lengths)
    for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
        for x in range(start, start + length):
            fits = [9 * min(n[x] - pos[x], n[y] - pos[y]) >= 4 * (n[x] + n[y]) for y in range(start, start + length) if y != x]
            assert live[x] == any(fits) if length <= count_rtree.LEAF else live[x] >= any(fits)
    assert not live.all()


def test_counts_come_back_whole():
    rows = [np.arange(count_rtree.GROUPS) * k for k in (0, 1, 2, 300)]
    packed = [count_rtree.pack_counts(r) for r in rows]
    assert [len(p) // count_rtree.GROUPS for p in packed] == [1, 1, 2, 4]
    assert (count_rtree.unpack_counts(packed) == np.stack(rows)).all()


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 6, (40, count_rtree.GROUPS))
    points = np.abs(base[rng.integers(0, 40, 500)] + rng.integers(-1, 2, (500, count_rtree.GROUPS)) * (rng.random((500, count_rtree.GROUPS)) < 0.1))
    sizes, comps = points.sum(1), rng.integers(0, 100, 500)
    shared = np.minimum(points[:, None], points[None]).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero((9 * shared >= 4 * (sizes[:, None] + sizes)) & (comps[:, None] != comps)), strict=True) if i < j}
    got = [p for a, b in count_rtree.tree_pairs(points, sizes, comps, np.arange(500), None) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert want and {tuple(sorted(p)) for p in got} == want and len(got) == len(want)
    left, right = np.arange(250), np.arange(250, 500)
    across = {tuple(sorted(p)) for a, b in count_rtree.tree_pairs(points, sizes, comps, left, right) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert across == {p for p in want if p[0] < 250 <= p[1]}


def test_components(spark):
    links = [(i + 1, i) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(41), 100]}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
