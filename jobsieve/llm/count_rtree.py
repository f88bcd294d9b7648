"""N-gram Jaccard join by R-trees over count vectors.

A document is the set of its five-word shingles. Shingles are hashed into groups, and the counts per group are a point: two
sets share at most the sum of the coordinate minima, and two boxes of points at most that of their upper corners. An
R-tree over the points so rules out whole branches; the sets of surviving pairs are compared.

In so many dimensions one tree over all documents prunes too little: unrelated long texts of one size lie as near to each
other in any few coordinates as copies do. So trees are built per bucket. Sets of similarity 0.8 share one of the rarest
fifth (and one) of their shingles, in any fixed order of all shingles; the order here is by a counter table over all
documents. A bucket is what shares such a shingle. A set that many shingles of that order precede there, or whose size is
unlike all others', has no partner in the bucket and leaves it. First every member of a bucket is held against its smallest
one, which settles most of a group of copies without its pairs. Then come rounds over the buckets that are still in several
components, but those of two sets: from their trees every component takes its nearest candidates in other components, those are verified, and
components grow together. The number it takes grows from round to round until no tree had to leave one out, so that no
link is lost, and a component that has found its group makes no further pairs with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.llm.components import components
from jobsieve.llm.store import stored
from jobsieve.llm.words import Kept, flat, gram_hashes, hash_filter, may_hold, mix, small, space_words

SHINGLE = 5
# Similarity 0.8: shared / union >= 4 / 5, so 9 * shared >= 4 * (size + size), and no size is under 4 / 5 of the other.
GROUPS = 256
TREE_GROUPS = 64  # the tree adds groups up; what it leaves is bounded anew by all of them
COUNTERS = 20  # bits of the counter table
_COLUMNS = 64
LEAF = 32
BLOCK = 4096  # a tree's points; larger buckets are dealt out as pairs of blocks
GROWTH = 8  # how many times more candidates a component takes in the next round
_HELD = 1 << 18  # pairs of a bucket that are held before they are thinned out


def shingle_sets(texts: list[str | None], hashes: Kept) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; a shorter text is one shingle, one without words has none."""
    values, ends, _ = flat(texts, space_words, hashes, np.uint64)
    grams = gram_hashes(values, SHINGLE)
    out, start = [], 0
    for end in ends.tolist():
        n = end - start
        if n >= SHINGLE:
            out.append(np.unique(grams[start: end - SHINGLE + 1]))
        else:
            out.append(mix(gram_hashes(values[start:end], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
        start = end
    return out


def set_id(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent 64-bit sums over a set: its id (fewer ``bits`` if asked for), and the proof of it."""
    with np.errstate(over="ignore"):
        pair = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    one, two = (int(x.astype(np.int64)) for x in pair)
    return (one if bits == 64 else one & ((1 << bits) - 1)), two


def _counters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, total = Kept(xxhash.xxh64_intdigest), np.zeros(1 << COUNTERS, np.int64)
    for batch in small(batches, 0):
        sets = shingle_sets(batch.column(0).to_pylist(), hashes)
        total += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
    table = total.reshape(-1, _COLUMNS)
    used = np.flatnonzero(table.sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(table[used, c]) for c in range(_COLUMNS))],
                                     names=["row", *(f"c{c}" for c in range(_COLUMNS))])


def shingle_counters(texts: DataFrame) -> np.ndarray:
    """How often shingles of a hash prefix occur, over all texts. Any table gives right results; a true one small buckets."""
    schema = "row int, " + ", ".join(f"c{c} long" for c in range(_COLUMNS))
    rows = texts.mapInArrow(_counters, schema).groupBy("row").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(_COLUMNS))).toArrow()
    out = np.zeros((1 << COUNTERS) // _COLUMNS * _COLUMNS, np.uint32).reshape(-1, _COLUMNS)
    if rows.num_rows:
        out[rows["row"].to_numpy()] = np.stack([rows[f"c{c}"].to_numpy() for c in range(_COLUMNS)], 1).clip(0, 2**32 - 1)
    return out.ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts per group in the fewest bytes each that hold them all; the length tells how many."""
    return counts.astype(f"<u{1 if (most := counts.max()) < 256 else 2 if most < 65536 else 4}").tobytes()


def unpack_counts(packed: list[bytes]) -> np.ndarray:
    """A row of counts per group for each of ``packed``."""
    out = np.zeros((len(packed), GROUPS), np.uint32)
    for k, one in enumerate(packed):
        out[k] = np.frombuffer(one, f"<u{len(one) // GROUPS}")
    return out


def _sketcher(counters: np.ndarray, bits: int):
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Kept(xxhash.xxh64_intdigest), Kept(lambda _: True)
        for batch in small(batches, 1):
            rows = []
            for s in shingle_sets(batch.column(1).to_pylist(), hashes):
                n = len(s)
                one, two = set_id(s, bits)
                keys: np.ndarray = np.zeros(0, np.int64)
                if n and (one, two) not in seen:  # a copy in the same task adds nothing
                    order = np.lexsort((s, counters[(s >> np.uint64(64 - COUNTERS)).astype(np.int64)]))
                    keys = s[order[: n - (4 * n + 4) // 5 + 1]].view(np.int64)
                    seen[one, two]
                counts = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
                rows.append((n, one, two, keys, pack_counts(counts)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "raw", "proof", "keys", "counts"])

    return sketch


def _fits(n: np.ndarray, room: np.ndarray, m: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles can be similar, if no common shingle comes before the one that both are
    here for. ``room`` is ``5 * n - 9 * pos``: of a set at most ``n - pos`` shingles are shared."""
    return (4 * m <= room) & (4 * n <= space)


def _live(n: np.ndarray, room: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which rows fit another one of their run. In a long run a row may count as its own partner, which only keeps more."""
    live = np.zeros(len(n), bool)
    for length in np.unique(lengths).tolist():
        own = starts[lengths == length]
        if length <= LEAF:
            step = max(1, (1 << 20) // length**2)
            for k in range(0, len(own), step):
                at = own[k: k + step, None] + np.arange(length)
                fits = _fits(n[at][:, :, None], room[at][:, :, None], n[at][:, None], room[at][:, None])
                fits[:, np.arange(length), np.arange(length)] = False
                live[at] = fits.any(2)
        else:
            for start in own.tolist():
                part = slice(start, start + length)
                order = np.argsort(n[part])
                most = np.maximum.accumulate(room[part][order])  # of all sets up to a size
                upto = np.searchsorted(4 * n[part][order], room[part], "right")
                live[part] = (upto > 0) & (most[np.maximum(upto, 1) - 1] >= 4 * n[part])
    return live


def _run_starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``(key, id, n * 2**32 + pos)`` in order of key and id: every id that fits another one of its key (see ``_fits``), but the
    first of them, with that first one as its leader, and whether the two fit. Similar sets fit where their first common
    shingle is the key. A run at either end of the partition may go on elsewhere: all its ids stay, and its leader is told
    as an edge."""

    def rows(key, ident, leader, fits, edge) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ident, pa.int64()), pa.array(leader, pa.int64()), pa.array(fits),
                                           pa.array(np.full(len(key), edge))], names=["key", "id", "leader", "fits", "edge"])

    def inner(key, ident, n_pos) -> pa.RecordBatch:
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
        key, ident, n, pos = key[once], ident[once], n_pos[once] >> 32, n_pos[once] & 0xFFFFFFFF
        room = 5 * n - 9 * pos
        starts, lengths = _run_starts(key)
        live = _live(n, room, starts[lengths > 1], lengths[lengths > 1])
        key, ident, n, room = key[live], ident[live], n[live], room[live]
        starts, lengths = _run_starts(key)
        first = np.repeat(starts, lengths)
        found = first != np.arange(len(key))
        fits = _fits(n, room, n[first], room[first])
        return rows(key[found], ident[found], ident[first][found], fits[found], False)

    def outer(key, ident) -> Iterator[pa.RecordBatch]:
        found = ident[1:][ident[1:] != ident[:-1]]
        yield rows(key[:1], ident[:1], ident[:1], np.ones(1, bool), True)
        yield rows(key[: len(found)], found, np.full(len(found), ident[0]), np.ones(len(found), bool), False)

    held: list[list[np.ndarray]] = []
    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        if held[0][0][0] == held[-1][0][-1]:  # one run so far
            continue
        table = [np.concatenate(c) for c in zip(*held, strict=True)]
        low = 0 if begun else int(np.searchsorted(table[0], table[0][0], "right"))
        high = int(np.searchsorted(table[0], table[0][-1]))
        if not begun:
            yield from outer(*(c[:low] for c in table[:2]))
        yield inner(*(c[low:high] for c in table))
        held, begun = [[c[high:] for c in table]], True
    if held:
        yield from outer(*(np.concatenate(c) for c in list(zip(*held, strict=True))[:2]))


# --- the tree ------------------------------------------------------------------------------------------------------


class Node:
    """A box of points: upper corner, smallest and largest size, the one component all are in (or None), and what it holds."""

    __slots__ = ("top", "least", "most", "comp", "rows", "kids")

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, rows: np.ndarray):
        own = points[rows]
        self.top, self.least, self.most = own.max(0), sizes[rows].min(), sizes[rows].max()
        self.comp = comps[rows[0]] if (comps[rows] == comps[rows[0]]).all() else None
        self.rows, self.kids = rows, ()
        if len(rows) > LEAF:
            spread = own.max(0) - own.min(0)
            by = sizes[rows] if self.most - self.least > spread.max() else own[:, int(spread.argmax())]
            order = np.argsort(by, kind="stable")
            half = len(rows) // 2
            self.kids = tuple(Node(points, sizes, comps, rows[part]) for part in (order[:half], order[half:]))


def _near(u: Node, v: Node) -> bool:
    if u.comp is not None and u.comp == v.comp:
        return False
    if 5 * u.most < 4 * v.least or 5 * v.most < 4 * u.least:
        return False
    return 9 * int(np.minimum(u.top, v.top).sum()) >= 4 * (int(u.least) + int(v.least))


def tree_pairs(points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components that may be similar, within ``left``, or between it and ``right``."""
    u = Node(points, sizes, comps, left)
    v = u if right is None else Node(points, sizes, comps, right)
    stack = [(u, v)]
    while stack:
        u, v = stack.pop()
        if not _near(u, v):
            continue
        if u.kids and (not v.kids or len(u.rows) >= len(v.rows)):
            if u is v:
                a, b = u.kids
                stack += [(a, a), (a, b), (b, b)]
            else:
                stack += [(k, v) for k in u.kids]
        elif v.kids:
            stack += [(u, k) for k in v.kids]
        else:
            shared = np.minimum(points[u.rows][:, None], points[v.rows][None]).sum(2, dtype=np.int64)
            a, b = np.nonzero((9 * shared >= 4 * (sizes[u.rows][:, None] + sizes[v.rows][None])) & (comps[u.rows][:, None] != comps[v.rows][None]))
            a, b = u.rows[a], v.rows[b]
            yield (a[a < b], b[a < b]) if u is v else (a, b)


def _trees(top: int):
    """Of every (bucket, pair of blocks), from rows in that order, the ``top`` nearest pairs of each component in it. A group
    has at most two blocks of rows; one that a batch cuts is held back for the next. Groups of two rows, the most by far,
    are compared all at once."""

    def trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            starts = _group_starts(table)
            held = table.slice(int(starts[-1]))
            yield _pairs_of(table.slice(0, int(starts[-1])), starts[:-1], top)
        if held is not None:
            yield _pairs_of(held, _group_starts(held), top)

    return trees


def _group_starts(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for c in ("key", "i", "j"):
        x = table[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _close(points: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs that all coordinates leave, and how near they may be at most."""
    for k in range(0, len(a), 4096):
        x, y = a[k: k + 4096], b[k: k + 4096]
        shared, total = 9 * np.minimum(points[x], points[y]).sum(1, dtype=np.int64), 4 * (sizes[x] + sizes[y])
        keep = shared >= total
        yield x[keep], y[keep], shared[keep] / total[keep]


def _nearest(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], comps: np.ndarray, ids: np.ndarray, top: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], bool]:
    """The pairs that are among the ``top`` nearest of either one's component, and whether others were left out."""
    a, b, bound = (np.concatenate([f[k] for f in found]) for k in range(3))
    n = len(a)
    if not n:
        return (a, b, bound), False
    side, pair = np.concatenate([comps[a], comps[b]]), np.tile(np.arange(n), 2)
    order = np.lexsort((np.tile(np.minimum(ids[a], ids[b]), 2), np.tile(np.maximum(ids[a], ids[b]), 2), -np.tile(bound, 2), side))
    new = np.ones(2 * n, bool)
    new[1:] = side[order][1:] != side[order][:-1]
    rank = np.arange(2 * n) - np.maximum.accumulate(np.where(new, np.arange(2 * n), 0))
    keep = np.unique(pair[order[rank < top]])
    return (a[keep], b[keep], bound[keep]), len(keep) < n


def _key_sets(table: pa.Table):
    """The keys of a row's set, made when they are first asked for."""
    lists = table["keys"].combine_chunks()
    values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    starts, made = ends - lists.value_lengths().to_numpy(), {}

    def own(row: int) -> frozenset:
        if row not in made:
            made[row] = frozenset(values[starts[row]: ends[row]].tolist())
        return made[row]

    return own


def _pairs_of(table: pa.Table, starts: np.ndarray, top: int) -> pa.RecordBatch:
    sizes, comps, ids, block, i, j = (table[c].to_numpy() for c in ("n", "comp", "id", "block", "i", "j"))
    points = unpack_counts(table["counts"].to_pylist())
    boxes = points.reshape(-1, TREE_GROUPS, GROUPS // TREE_GROUPS).sum(2)
    ends = np.append(starts, table.num_rows)[1:]
    two = starts[(ends - starts == 2) & (i[starts] == j[starts])] if len(starts) else starts
    two = two[comps[two] != comps[two + 1]]
    key, cuts = table["key"].to_numpy(), []
    found = list(_close(points, sizes, two, two + 1))
    none = np.zeros(0, np.int64)
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if end - start == 2 and i[start] == j[start]:
            continue
        rows = np.arange(start, end)
        if i[start] != j[start]:
            sides = [(rows[block[start:end] == i[start]], rows[block[start:end] == j[start]])]
        else:  # the rows of the largest component need no pairs among themselves
            names, sizes_of = np.unique(comps[start:end], return_counts=True)
            most = comps[start:end] == names[sizes_of.argmax()]
            sides = [(rows[~most], None), (rows[~most], rows[most])]
        own, held, left_out = [(none, none, none.astype(float))], 0, False
        for left, right in sides:
            if not len(left) or (right is not None and not len(right)):
                continue
            for x, y in tree_pairs(boxes, sizes, comps, left, right):
                for part in _close(points, sizes, x, y):
                    own.append(part)
                    held += len(part[0])
                if held > _HELD:
                    best, cut = _nearest(own, comps, ids, top)
                    own, held, left_out = [best], 0, left_out or cut
        best, cut = _nearest(own, comps, ids, top)
        found.append(best)
        if left_out or cut:
            cuts.append(int(key[start]))
    a, b, bound = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (none, none, none.astype(float))
    # Two sets often share many buckets: the pair leaves the one with their smallest common key only.
    own_keys = _key_sets(table)
    first = np.fromiter((min(own_keys(x) & own_keys(y)) == k for x, y, k in zip(a.tolist(), b.tolist(), key[a].tolist(), strict=True)), bool, len(a))
    a, b, bound = a[first], b[first], bound[first]
    swap = ids[a] < ids[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    columns = [pa.array(x) for x in (ids[a], ids[b], comps[a], comps[b], bound)]
    marks = [pa.nulls(len(cuts), c.type) for c in columns]
    keys, cut = pa.array([*key[a].tolist(), *cuts], pa.int64()), pa.array(np.repeat([False, True], [len(a), len(cuts)]))
    return pa.RecordBatch.from_arrays([keys, *(pa.concat_arrays(c) for c in zip(columns, marks, strict=True)), cut],
                                      names=["key", "a", "b", "ca", "cb", "bound", "cut"])


def _bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose coordinate minima add up to enough."""
    for batch in batches:
        if batch.num_rows:
            x, y = (unpack_counts(batch.column(k).to_pylist()) for k in ("nac", "nbc"))
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = 9 * np.minimum(x, y).sum(1, dtype=np.int64) >= 4 * total
            yield batch.filter(pa.array(keep)).drop_columns(["nac", "nbc"])


def _set_reader(wanted_bits: np.ndarray, bits: int):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Kept(xxhash.xxh64_intdigest), Kept(lambda _: True)
        for batch in batches:
            wanted = may_hold(wanted_bits, batch.column(0).to_numpy().view(np.uint64))
            for piece in small([batch.filter(pa.array(wanted))], 1):
                rows = []
                for s in shingle_sets(piece.column(1).to_pylist(), hashes):
                    ident = set_id(s, bits)
                    if len(s) and ident not in seen:
                        seen[ident]
                        rows.append((*ident, s.view(np.int64)))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["raw", "proof", "shingles"])

    return read


def _id_hash(column: str):
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("null")))


class ShingleJoin:
    """The tables of one join: a row per document, and a row per distinct set.

    A set is named by 64 bits of hash. Different sets with one name (``proof`` tells them apart) get names of their own, all
    but one. ``id_bits`` makes names shorter, which changes no result: tests force such clashes with it.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64):
        self.docs, self.id_bits = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), id_bits
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        counters = shingle_counters(self.docs.select("text"))
        rows = stored(self.docs.mapInArrow(
            _sketcher(counters, id_bits), f"doc_id {kind}, n long, raw long, proof long, keys array<bigint>, counts binary"), "shingle-rows")
        of = [F.min("doc_id").alias("first_id"), F.max(F.struct("n", "counts")).alias("s"), F.min("proof").alias("proof"), F.max("proof").alias("other")]
        sets = stored(rows.where("n > 0").groupBy("raw").agg(*of).select(F.col("raw").alias("id"), "raw", "proof", "other", "first_id", "s.n", "s.counts"), "shingle-sets")
        if not sets.where("proof <> other").limit(1).count():
            self.sets, self.rows = sets.drop("other"), rows.withColumnRenamed("raw", "id")
            return
        sets = rows.where("n > 0").groupBy("raw", "proof").agg(*of[:2]).select(F.col("raw").alias("id"), "raw", "proof", "first_id", "s.n", "s.counts")
        self.sets = stored(self._own_names(stored(sets, "shingle-sets")), "shingle-sets")
        self.rows = stored(rows.join(self.sets.select("raw", "proof", "id"), ["raw", "proof"], "left").drop("raw"), "shingle-rows")

    def _own_names(self, sets: DataFrame) -> DataFrame:
        """``sets`` with an ``id`` that no two share."""
        salt = 0
        while True:
            shared = stored(sets.groupBy("id").agg(F.min(F.struct("raw", "proof")).alias("stays"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "clashes")
            if not shared.count():
                return sets
            salt += 1
            moves = F.col("stays").isNotNull() & (F.struct("raw", "proof") != F.col("stays"))
            sets = stored(sets.join(shared, "id", "left").withColumn("id", F.when(moves, F.xxhash64(F.lit(salt), "raw", "proof")).otherwise(F.col("id"))).drop("stays"), "shingle-sets")

    def buckets(self) -> DataFrame:
        """``(key, id, leader, fits, edge)``, see ``_runs``. Ranges are cut by key and id, so that a key with very many sets is split."""
        keys = self.rows.select(F.posexplode("keys").alias("pos", "key"), "id", "n").select("key", "id", (F.shiftleft("n", 32) + F.col("pos")).alias("n_pos"))
        return stored(keys.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
                      .mapInArrow(_runs, "key long, id long, leader long, fits boolean, edge boolean"), "buckets")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Of distinct ``(a, b)``, those of similarity 0.8 or more. Sets are read again from the texts of the ids in question only."""
        of = lambda c: self.met.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"n{c}c"), F.col("raw").alias(f"raw{c}"), F.col("proof").alias(f"proof{c}"))
        sized = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("5 * na >= 4 * nb and 5 * nb >= 4 * na")
        names = ["a", "b", "na", "nb", "rawa", "proofa", "rawb", "proofb"]
        close = stored(sized.select(*names, "nac", "nbc").mapInArrow(_bounded, ", ".join(f"{c} long" for c in names)), "close-pairs")
        ids = stored(close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
                     .join(self.met.select("id", "first_id"), "id").select(_id_hash("first_id").alias("h")), "wanted-sets")
        bits = hash_filter(ids, "h", 64)
        read = stored(self.docs.select(_id_hash("doc_id").alias("h"), "text").mapInArrow(_set_reader(bits, self.id_bits), "raw long, proof long, shingles array<bigint>"), "read-sets")
        side = lambda c, x: read.select(F.col("raw").alias(f"raw{c}"), F.col("proof").alias(f"proof{c}"), F.col("shingles").alias(x))
        both = close.join(side("a", "x"), ["rawa", "proofa"]).join(side("b", "y"), ["rawb", "proofb"])
        return stored(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b").distinct(), "links")

    def leader_pairs(self, buckets: DataFrame) -> DataFrame:
        """Every member with its leader, and the leaders of a bucket that lies in several partitions with the smallest of them."""
        edges = buckets.where("edge").select("key", "leader").distinct()
        tops = edges.groupBy("key").agg(F.min("leader").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
        across = edges.join(tops, "key").where("leader <> top").select("key", F.col("leader").alias("id"), F.col("top").alias("leader"), F.lit(True).alias("fits"))
        return buckets.where("not edge").select("key", "id", "leader", "fits").union(across)

    def open_members(self, led: DataFrame, labels: DataFrame) -> DataFrame:
        """``(key, id)`` of the buckets in several components. Buckets of the same sets are one; of two sets, their pair is tried."""
        comp = lambda c, n: labels.select(F.col("id").alias(c), F.col("comp").alias(n))
        met = led.select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
        apart = (met.join(comp("a", "ca"), "a", "left").join(comp("b", "cb"), "b", "left")
                 .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(F.col("a").alias("id"), F.col("b").alias("leader")))
        open_keys = stored(led.join(stored(apart, "apart"), ["id", "leader"], "left_semi").select("key").distinct(), "open-keys")
        rows = led.join(open_keys, "key", "left_semi")
        members = stored(rows.select("key", "id").union(rows.select("key", F.col("leader"))).distinct(), "members")
        marks = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"),
                                           F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"))
        return stored(members.join(marks.where("c > 2").groupBy("c", "lo", "hi", "sum").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"), "open-members")

    def tree_candidates(self, rows: DataFrame, labels: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
        """``rows`` of the buckets that still are in several components, and the ``top`` nearest pairs of every component
        there. A row whose ``cut`` is true says that a tree of its bucket left others out."""
        named = stored(rows.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")), "named-members")
        parts = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
            F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        # In a bucket of more than one block the largest component's blocks (the first ones) meet only blocks of others.
        whole = F.col("c") <= BLOCK
        parts = parts.select("key", F.col("most.comp").alias("most"), F.when(whole, 0).otherwise(F.ceil(F.col("most.c") / BLOCK)).cast("int").alias("ours"),
                             F.when(whole, 1).otherwise(F.ceil((F.col("c") - F.col("most.c")) / BLOCK)).cast("int").alias("theirs"))
        left = stored(named.join(parts, "key"), "open-members")
        own = left.groupBy("id", "comp").agg(F.collect_list("key").alias("keys"))  # no more than a set's rarest fifth
        sets = own.join(self.met.select("id", "n", "counts"), "id").drop("comp")
        ours = (F.col("ours") > 0) & (F.col("comp") == F.col("most"))
        h, last = F.xxhash64("id"), F.col("ours") + F.col("theirs") - 1
        points = left.join(sets, "id").select(
            "key", "id", "comp", "n", "counts", "keys", F.when(ours, F.pmod(h, "ours")).otherwise(F.col("ours") + F.pmod(h, "theirs")).cast("int").alias("block"),
            F.explode(F.sequence(F.when(ours, F.col("ours")).otherwise(F.lit(0)), last)).alias("other"))
        pairs = (points.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
                 .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                 .mapInArrow(_trees(top), "key long, a long, b long, ca long, cb long, bound double, cut boolean"))
        return left.select("key", "id"), stored(pairs, "tree-pairs")

    def labels(self) -> DataFrame:
        """``(id, comp)`` of all sets with a link to another one: enough links are verified to know every component whole."""
        led = self.leader_pairs(self.buckets())
        ids = led.select("id").union(led.select("leader")).distinct()
        self.met = stored(self.sets.join(ids, "id", "left_semi"), "met-sets")
        stars = stored(led.where("fits").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "leader-pairs")
        labels, tried, top = components(self.verify(stars)), stars, 1
        rows = self.open_members(led, labels)
        while True:
            rows, pairs = self.tree_candidates(rows, labels, top)
            fresh = stored(pairs.where("not cut").join(tried, ["a", "b"], "left_anti"), "fresh-pairs")
            sides = fresh.select("a", "b", "bound", F.explode(F.array("ca", "cb")).alias("comp"))
            place = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("bound"), "a", "b"))
            best = stored(sides.withColumn("place", place).where(F.col("place") <= top).select("a", "b").distinct(), "best-pairs")
            if best.limit(1).count():
                links = self.verify(best)
                if links.limit(1).count():
                    labels = components(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(links))
                tried = tried.union(best)
            # A bucket goes on if its trees or the ranking left out a pair; all pairs of others are tried.
            waiting = fresh.join(best, ["a", "b"], "left_anti").select("key").union(pairs.where("cut").select("key")).distinct()
            rows = stored(rows.join(waiting, "key", "left_semi"), "open-members")
            if not rows.limit(1).count():
                return labels
            top *= GROWTH


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """One row per row: ``doc_id, n_shingles, component_id``, the smallest id reachable by links of similarity 0.8 or more.

    Null, empty and word-less texts have no shingles and are their own component; fewer than five words are one shingle. Rows
    of equal sets are linked, repeated rows too. Null ids count as no id in the minimum. Extra columns are ignored.
    """
    join = ShingleJoin(docs, id_col, text_col, id_bits)
    labels = join.labels()
    named = stored(join.sets.select("id", "first_id").join(labels, "id", "left").select("id", "first_id", F.coalesce("comp", "id").alias("comp")), "named")
    least = stored(named.groupBy("comp").agg(F.min("first_id").alias("component_id")), "least")
    by_set = stored(named.join(least, "comp").select("id", "component_id"), "set-components")
    return (join.rows.select("doc_id", "n", "id").join(by_set, "id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
