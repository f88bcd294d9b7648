"""String helpers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsieve.functions.regex import rx


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(c: Column | str) -> Column:
    """White-space runs to one blank, ends trimmed."""
    # A single plain blank already is what it should be; only the rest is rewritten.
    return F.trim(F.regexp_replace(col(c), rx("(?![!-~])(?:{S}{2,}|(?! ){S})"), " "))


def squash_lower(c: Column | str) -> Column:
    return F.lower(squash(c))


def trim_all(c: Column | str) -> Column:
    """Trim every kind of white space, inner runs untouched."""
    return F.regexp_replace(col(c), rx(r"^{S}+|{S}+\z"), "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(trim_all(c), F.lit("")) == ""


PIECE = 2048


class Sliced:
    """A text together with its consecutive pieces.

    Taking a substring walks the text from its start. Where many short windows are read from one long text,
    each is cut from the one or two pieces it lies in instead.
    """

    def __init__(self, text: Column, pieces: Column):
        self.text, self.pieces = text, pieces


def sliced(text: Column, body) -> Column:
    """``body(Sliced)`` with the pieces computed once."""
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1," + str(PIECE) + "}"), F.lit(0))
    return let(pieces, lambda p: body(Sliced(text, p)))


def _cut(c: Column, lo: Column, n: Column) -> Column:
    return F.substring(c, lo + 1, F.greatest(n, F.lit(0)))


def clip(c: Column | str | Sliced, start: Column, end: Column) -> Column:
    """Zero-based slice ``[start, end)``, clamped at zero."""
    lo = F.greatest(start, F.lit(0))
    if not isinstance(c, Sliced):
        return _cut(col(c), lo, end - lo)
    at = F.floor(lo / PIECE).cast("int")
    pair = F.concat(or_empty(F.get(c.pieces, at)), or_empty(F.get(c.pieces, at + 1)))
    return F.when(end - lo <= PIECE, _cut(pair, lo % PIECE, end - lo)).otherwise(_cut(c.text, lo, end - lo))


def snippet(c: Column | str | Sliced, start: Column, end: Column, pad: int) -> Column:
    return squash(clip(c, start - pad, end + pad))


def norm_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(or_empty(c)), "[^a-z0-9]+", " "))


def split_terms(c: Column | str) -> Column:
    """Comma list to trimmed lower-case terms, blanks dropped."""
    parts = F.transform(F.split(or_empty(c), ","), lambda s: F.lower(trim_all(s)))
    return F.filter(parts, lambda s: s != "")


def search_terms(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(or_empty(c)), rx("{S}+")), lambda s: s != "")


def csv_cell(c: Column | str) -> Column:
    """Quote only when the cell holds a quote, comma or line break; null becomes an empty cell."""
    s = or_empty(col(c).cast("string"))
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.rlike('[",\n\r]'), quoted).otherwise(s)


def pane_signature(title: Column | str, body: Column | str) -> Column:
    """Title, body length, head 140 and tail 80: tells two panes apart."""
    return let(
        squash(or_empty(body)),
        lambda b: F.concat_ws(
            "|",
            squash(or_empty(title)),
            F.length(b).cast("string"),
            F.substring(b, F.lit(1), F.lit(140)),
            F.right(b, F.lit(80)),
        ),
    )


def js_round(c: Column) -> Column:
    """Half-up rounding to a whole number, the way the source rounds."""
    return F.floor(c + F.lit(0.5)).cast("long")


def grouped(c: Column) -> Column:
    """Whole number with thousands separators; halves rounded up, not to even."""
    return F.format_number(js_round(c), 0)
