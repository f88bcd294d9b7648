"""One HTML page to one array of element records.

This is the only place where Python reads page text: a tolerant tokenizer walk that numbers elements in
document order. Element ``i`` of the array is element number ``i``; ``parent`` and ``last`` (its last
descendant) turn "inside", "ancestor" and "sibling" into integer comparisons, and text is kept once per
page with start/end offsets per element, so deep nesting never multiplies text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from jobsieve.functions import header as H

# Boxes that hold other elements. Their text is cut from the page where it is wanted; only a box that could be a label
# itself keeps a copy, or every level of nesting would keep its own. All other elements keep their text at any length.
BOXES = frozenset(
    "html head body main div section article header footer nav aside form fieldset ul ol dl table thead tbody tfoot tr td"
    " th details dialog blockquote figure".split())
LABEL_CHARS = 300  # above every bound that a rule on a label has (200 at most)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNRENDERED = frozenset(("script", "style", "noscript"))
# Tags that break lines in rendered text.
LINE_TAGS = frozenset(
    "p div li ul ol br h1 h2 h3 h4 h5 h6 tr section article header footer blockquote table".split())
BLOCKS = frozenset(("div", "section", "article", "main"))
CLOSES = {  # an opening tag closes an open one of these, up to the nearest boundary
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select"}),
}
LINK_REACH = 10  # levels above a job link at which it still counts for a list (``n_near``)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split())

CLOSING = ENDS_PARAGRAPH | CLOSES.keys()
ENDS_LINE = LINE_TAGS - {"li", "br"}

_INTS = ("ord", "parent", "last", "depth", "raw_start", "raw_end", "out_start", "out_end", "text_len", "norm_len",
         "n_children", "run", "more", "n_links", "n_near")
_KINDS = {
    **dict.fromkeys(_INTS, T.IntegerType()), "tag": T.StringType(), "own_text": T.StringType(), "text": T.StringType(),
    "css_path": T.StringType(), "attrs": T.MapType(T.StringType(), T.StringType()), "in_chrome": T.BooleanType(),
    "hidden": T.BooleanType(), "text_hash": T.LongType(), "job_id": T.StringType(), "is_link": T.BooleanType(),
}
ELEMENT = T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()])
PAGE = T.StructType([
    T.StructField("raw", T.StringType()), T.StructField("rendered", T.StringType()),
    T.StructField("els", T.ArrayType(ELEMENT)),
])


# Plain markup: text, tags whose attributes are quoted or bare, whole scripts and styles, comments, a doctype. A page made of these
# alone is cut by one pattern into what the standard parser would report; any other page goes through that parser.
_ATTRS = r'((?:[ \t\n]+[a-zA-Z_][-a-zA-Z0-9_:.]*(?:="[^"]*")?)*)[ \t\n]*'
_PLAIN = re.compile(
    r"([^<]+)|</([a-zA-Z][a-zA-Z0-9]*)>"
    rf"|<(script|style){_ATTRS}>([^<]*(?:<(?:(?!/|!--)|/(?!script|style)[a-z][a-z0-9]*>)[^<]*)*)</\3>"
    rf"|<([a-zA-Z][a-zA-Z0-9]*){_ATTRS}(/?)>"
    r"|<!--(?!-?>)[^-]*(?:-(?!-)[^-]*)*-->|<!(?:doctype|DOCTYPE)[^>]*>|(<)")
_ATTR = re.compile(r'([a-zA-Z_][-a-zA-Z0-9_:.]*)(?:="([^"]*)")?')
SLICE_CHARS, SLICE_PAGES = 1_000_000, 256  # pages whose elements are held in Python at a time

_BLANKS = re.compile(r"\s+")
_SPACES = np.zeros(0x10000, dtype=bool)  # white space by code point; none lies beyond this plane
_SPACES[[i for i in range(0x10000) if _BLANKS.match(chr(i)) or i == 0xFEFF]] = True


class _Element:
    __slots__ = ("ord", "up", "last", "depth", "tag", "attrs", "own", "flat", "raw_start", "raw_end", "out_start", "out_end",
                 "run", "more", "kids", "in_chrome", "hidden", "mutes", "nth", "path")

    def __init__(self, ord, up, depth, tag, attrs, raw_start, in_chrome, hidden, mutes):
        self.ord, self.up, self.depth, self.tag, self.attrs, self.raw_start = ord, up, depth, tag, attrs, raw_start
        self.in_chrome, self.hidden, self.mutes = in_chrome, hidden, mutes
        self.own = self.flat = self.kids = self.nth = self.path = None
        self.run, self.more = 1, 0


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.raw, self.out, self.els, self.stack, self.tops = [], [], [], [], []
        self.n_raw = self.n_out = self.silent = 0

    def _emit(self, s):
        if not self.silent:
            self.out.append(s)
            self.n_out += len(s)

    def _pop(self):
        e = self.stack.pop()
        if e.tag in ENDS_LINE:
            self._emit("\n")
        self.silent -= e.mutes
        if e.kids and len(e.kids) > 1:
            self._count_runs(e.kids)
        e.last, e.raw_end, e.out_end = len(self.els) - 1, self.n_raw, self.n_out

    @staticmethod
    def _count_runs(kids):
        """The first of a run of same-shaped siblings gets the run's length, the others 0; the second tells how many follow."""
        first = shape = None
        for k in kids:
            looks = k.attrs.get("class") if k.attrs else None
            mine = (k.tag, looks.split()[:3] if looks else [], len(k.kids) if k.kids else 0)
            if first is not None and mine == shape:
                first.run += 1
                k.run = 0
            else:
                first, shape = k, mine
        before = kids[0]
        for k in kids:
            if k.run == 0 and before.run > 2:
                k.more = before.run - 1
            before = k

    def _close_implied(self, tag):
        if tag in ENDS_PARAGRAPH:
            for i in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[i].tag
                if open_tag == "p":
                    while len(self.stack) > i:
                        self._pop()
                    break
                if open_tag in ENDS_PARAGRAPH or open_tag in ("li", "td", "th", "body", "button"):
                    break
        if tag in CLOSES:
            closes, stop = CLOSES[tag]
            for i in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[i].tag
                if open_tag in closes:
                    while len(self.stack) > i:
                        self._pop()
                    break
                if open_tag in stop:
                    break

    def handle_starttag(self, tag, attrs):
        self._open(tag, {k: (v or "") for k, v in attrs})

    def _open(self, tag, a):
        if tag in CLOSING:
            self._close_implied(tag)
        stack = self.stack
        up = stack[-1] if stack else None
        mutes, chrome, hidden = int(tag in UNRENDERED), tag == "nav", False
        if a:
            role, unseen = a.get("role", ""), a.get("aria-hidden") == "true"
            mutes |= unseen
            chrome = chrome or role == "navigation" or a.get("id") == "global-nav" or (tag == "header" and role == "banner")
            hidden = "hidden" in a or unseen
        if up is not None:
            chrome, hidden = chrome or up.in_chrome, hidden or up.hidden
        e = _Element(len(self.els), None if up is None else up.ord, len(stack), tag, a, self.n_raw, chrome, hidden, mutes)
        if up is None:
            self.tops.append(e)
        elif up.kids is None:
            up.kids = [e]
        else:
            up.kids.append(e)
        e.out_start = self.n_out
        self.els.append(e)
        stack.append(e)
        self.silent += mutes
        if tag in LINE_TAGS:
            self._emit("\n- " if tag == "li" else "\n")
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def updatepos(self, i, j):  # lines and columns are not asked for
        return j

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._pop()
                return

    def handle_data(self, data):
        self.raw.append(data)
        self.n_raw += len(data)
        flat = _squash(data)
        if self.stack:
            e = self.stack[-1]
            if e.own is None:
                e.own, e.flat = [data], flat
            else:
                e.own.append(data)
                e.flat = None
        if flat and not self.silent:
            self._emit(" " * data[0].isspace() + flat + " " * data[-1].isspace())


def _squash(s: str) -> str:
    return " ".join(s.split())


def _attrs_of(written: str) -> dict[str, str]:
    return {k.lower(): unescape(v) if "&" in v else v for k, v in _ATTR.findall(written)}


_known_attrs = lru_cache(4096)(_attrs_of)  # nobody writes to these


def _read_attrs(written: str) -> dict[str, str]:
    return _known_attrs(written) if len(written) <= 200 else _attrs_of(written)


def _walk_plain(html: str) -> _Walk | None:
    """The walk over a page of plain markup, or null if anything else is in it."""
    tokens = _PLAIN.findall(html)
    if any(t[8] for t in tokens):  # every other character belongs to a token
        return None
    w = _Walk()
    stack = w.stack
    for text, closed, mute, mute_attrs, code, tag, attrs, ends, _ in tokens:
        if text:
            w.handle_data(unescape(text) if "&" in text else text)
        elif closed:
            closed = closed.lower()
            if stack and stack[-1].tag == closed:
                w._pop()
            else:
                w.handle_endtag(closed)
        elif tag:
            tag = tag.lower()
            if tag in w.CDATA_CONTENT_ELEMENTS:
                return None
            w._open(tag, _read_attrs(attrs) if attrs else {})
            if ends and tag not in VOID:
                w.handle_endtag(tag)
        elif mute:
            w._open(mute, _read_attrs(mute_attrs) if mute_attrs else {})
            if code:
                w.handle_data(code)
            w.handle_endtag(mute)
    return w


def _walk(html: str) -> _Walk:
    w = _walk_plain(html)
    if w is None:
        w = _Walk()
        w.feed(html)
        w.close()
    while w.stack:
        w._pop()
    return w


# Java's ``$`` also stands before a line end that closes the text.
_DIRECT = re.compile(r"[0-9]+(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z")
_URN = re.compile(r"jobPosting:([0-9]+)")
_HREFS = [re.compile(p, re.ASCII) for p in H.ID_IN_HREF]
_MAY_NAME = frozenset((*H.ID_ATTRS, *H.URN_ATTRS, "href"))


def _job_id(a: dict[str, str]) -> str | None:
    """As ``header.job_id_from_attrs``."""
    direct = next((v for v in map(a.get, H.ID_ATTRS) if v), "").strip(" ")
    if direct and _DIRECT.match(direct):
        return direct
    found = _URN.search(next((v for v in map(a.get, H.URN_ATTRS) if v), ""))
    href = a.get("href")
    if not found and href:
        found = next((m for m in (p.search(href) for p in _HREFS) if m), None)
    return found[1] if found else None


def _names_job(tag: str, a: dict[str, str]) -> bool:
    """Whether an element with a job id is a link to the posting."""
    href = a.get("href") if tag == "a" else None
    return (bool(href) and ("/jobs/view/" in href or "currentJobId=" in href or "jobId=" in href)
            or any(n in a for n in H.ID_ATTRS) or any("jobPosting" in a.get(n, "") for n in H.URN_ATTRS))


def _path(e: _Element, els: list[_Element], tops: list[_Element]) -> str:
    """Tags and their numbers among like siblings, from the top; each is written once."""
    line = []
    while e is not None and e.path is None:
        line.append(e)
        e = None if e.up is None else els[e.up]
    path = e.path if e is not None else ""
    for e in reversed(line):
        if e.nth is None:
            counts = {}
            for k in els[e.up].kids if e.up is not None else tops:
                k.nth = counts[k.tag] = counts.get(k.tag, 0) + 1
        e.path = path = (path + ">" if path else "") + f"{e.tag}[{e.nth}]"
    return path


def _texts(w: _Walk, raw: str, firsts: list[int], lasts: list[int], norms: list[int], base: int) -> Iterator[tuple]:
    """Own text, text, place and digest of each element of a page."""
    odd = "\ufeff" in raw
    for e, first, last, norm_len in zip(w.els, firsts, lasts, norms):
        own = "" if e.own is None else e.flat if e.flat is not None else _squash("".join(e.own))
        text = ""
        if norm_len:
            if e.kids is None and not odd:
                text = own
            elif norm_len <= LABEL_CHARS or e.tag not in BOXES or e.kids is None:
                text = _squash(raw[first - base:last + 1 - base])
            else:
                text = None
        path = digest = None
        if e.tag in BLOCKS:
            path = _path(e, w.els, w.tops)
            if norm_len >= 200:
                body = _squash(raw[e.raw_start:e.raw_end]).encode()
                digest = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "big", signed=True)
        yield own, text, path, digest


_COUNTED = ("last", "depth", "raw_start", "raw_end", "out_start", "out_end", "run", "more")


def _columns(walks: list[_Walk], raws: list[str]) -> dict:
    """The elements of some pages, column by column."""
    els = list(chain.from_iterable(w.els for w in walks))
    counts = np.array([len(w.els) for w in walks], dtype=np.int64)
    page_el = np.repeat(np.cumsum(counts) - counts, counts)  # number of the first element of its page
    chars = np.array([len(r) for r in raws], dtype=np.int64)
    page_at = np.cumsum(chars) - chars
    base = np.repeat(page_at, counts)
    ints = {name: np.array(v, dtype=np.int64) for name, v in zip(_COUNTED, zip(*map(attrgetter(*_COUNTED), els)) if els else [()] * len(_COUNTED))}
    raw_start, raw_end, last_el = ints["raw_start"], ints["raw_end"], ints["last"]

    # Prefix counts make both text lengths of any element a constant-time lookup.
    codes = np.frombuffer("".join(raws).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    solid_at = ~_SPACES[np.minimum(codes, 0xFFFF)]
    solid = np.flatnonzero(solid_at)
    solid_before = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(solid_at, out=solid_before[1:])
    runs_before = np.zeros(len(codes) + 1, dtype=np.int64)
    if len(codes):
        np.cumsum(~solid_at & np.concatenate([[True], solid_at[:-1]]), out=runs_before[1:])
    starts = solid_before[raw_start + base]
    ends = np.maximum(starts, solid_before[raw_end + base])
    filled = ends > starts
    firsts, lasts = base.copy(), base - 1
    firsts[filled], lasts[filled] = solid[starts[filled]], solid[ends[filled] - 1]
    norms = np.where(filled, ends - starts + runs_before[lasts + 1] - runs_before[firsts], 0)

    ups = np.array([-1 if e.up is None else e.up for e in els], dtype=np.int64)
    up_at = np.where(ups < 0, -1, ups + page_el)
    job_ids = [_job_id(e.attrs) if e.attrs and not _MAY_NAME.isdisjoint(e.attrs) else None for e in els]
    links = [j is not None and _names_job(e.tag, e.attrs) for e, j in zip(els, job_ids)]
    ordinal = np.arange(len(els))
    upto = np.cumsum(np.array(links, dtype=np.int64))
    near, at = np.zeros(len(els), dtype=np.int64), np.flatnonzero(links)
    for _ in range(LINK_REACH):
        at = up_at[at]
        at = at[at >= 0]
        if not len(at):
            break
        near += np.bincount(at, minlength=len(els))

    cuts = np.cumsum([0, *counts]).tolist()
    f, t, n = firsts.tolist(), lasts.tolist(), norms.tolist()
    texts = list(chain.from_iterable(
        _texts(w, raw, f[a:b], t[a:b], n[a:b], at)
        for w, raw, a, b, at in zip(walks, raws, cuts, cuts[1:], page_at.tolist())))
    own, text, path, digest = zip(*texts) if texts else ((),) * 4
    return {
        "ord": ordinal - page_el, "parent": np.ma.masked_less(ups, 0), **ints, "text_len": lasts + 1 - firsts, "norm_len": norms,
        "n_children": np.array([len(e.kids) if e.kids else 0 for e in els], dtype=np.int64),
        "n_links": upto[last_el + page_el] - upto if len(els) else upto, "n_near": near, "tag": [e.tag for e in els], "own_text": own, "text": text,
        "css_path": path, "attrs": [e.attrs for e in els], "in_chrome": [e.in_chrome for e in els], "hidden": [e.hidden for e in els],
        "text_hash": digest, "job_id": job_ids, "is_link": links,
    }


def _read_pages(htmls: list[str | None]) -> pa.Array:
    """Pages as one struct array, put together column by column."""
    walks = [_walk(h or "") for h in htmls]
    raws = ["".join(w.raw) for w in walks]
    kind = to_arrow_type(PAGE)
    columns = _columns(walks, raws)

    def column(field: pa.Field) -> pa.Array:
        values = columns[field.name]
        if isinstance(values, np.ma.MaskedArray):
            return pa.array(values.data.astype(np.int32), mask=np.ma.getmaskarray(values))
        if isinstance(values, np.ndarray):
            return pa.array(values.astype(np.int32))
        if not pa.types.is_map(field.type):
            return pa.array(values, type=field.type)
        at = np.cumsum([0, *map(len, values)], dtype=np.int32)
        return pa.MapArray.from_arrays(
            pa.array(at), pa.array(list(chain.from_iterable(values)), type=field.type.key_type),
            pa.array(list(chain.from_iterable(a.values() for a in values)), type=field.type.item_type))

    element = kind.field("els").type.value_type
    els = pa.StructArray.from_arrays([column(f) for f in element], fields=list(element))
    offsets = np.cumsum([0, *(len(w.els) for w in walks)], dtype=np.int32)
    return pa.StructArray.from_arrays([
        pa.array(raws, type=kind.field("raw").type),
        pa.array(["".join(w.out) for w in walks], type=kind.field("rendered").type),
        pa.ListArray.from_arrays(pa.array(offsets), els).cast(kind.field("els").type)], fields=list(kind))


def read_page(html: str | None) -> dict:
    """Page text plus element records; whatever the markup, something readable comes back."""
    page = _read_pages([html])[0].as_py()
    return page | {"els": [e | {"attrs": dict(e["attrs"])} for e in page["els"]]}


def _slices(html: pa.Array) -> Iterator[list[str | None]]:
    """A batch's pages in short lists: what they hold in Python does not grow with the batch."""
    held, chars = [], 0
    for h in html:
        held.append(h.as_py())
        chars += len(held[-1] or "")
        if chars >= SLICE_CHARS or len(held) >= SLICE_PAGES:
            yield held
            held, chars = [], 0
    if held:
        yield held


@F.arrow_udf(PAGE)
def parse_html(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for html in batches:
        for pages in _slices(html):
            yield _read_pages(pages)
