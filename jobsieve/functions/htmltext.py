"""HTML to readable text with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsieve.functions.regex import rx
from jobsieve.functions.text import col, let

# ---- Fixed values: block tags and named entities ----
BLOCK_TAGS = (
    "address|article|aside|blockquote|div|dl|dd|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|main"
    "|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "bull": "•", "middot": "·",
    "trade": "™", "reg": "®", "copy": "©", "deg": "°", "eacute": "é",
}
# ---- end of fixed values ----


def _code_point(number: Column) -> Column:
    """A code point to its character, by writing out its UTF-8 bytes."""
    cont = lambda shift: (F.shiftright(number, shift).bitwiseAND(63) + 128)
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    octets = (
        F.when(number < 0x80, byte(number))
        .when(number < 0x800, F.concat(byte(F.shiftright(number, 6) + 192), byte(cont(0))))
        .when(number < 0x10000, F.concat(byte(F.shiftright(number, 12) + 224), byte(cont(6)), byte(cont(0))))
        .otherwise(F.concat(byte(F.shiftright(number, 18) + 240), byte(cont(12)), byte(cont(6)), byte(cont(0))))
    )
    return F.decode(F.unhex(octets), "UTF-8")


def _replace_each(text: Column, pattern: str, value) -> Column:
    """Rewrite every match of ``pattern`` with ``value(match)``: split around the matches and interleave."""
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.concat(gap, F.when(m.isNull(), F.lit("")).otherwise(value(m))),
    )
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def decode_entities(c: Column | str) -> Column:
    """Hex, decimal, then the named ones; an unknown name or an impossible code point stays as written."""

    def numeric(digits_of, base):
        def value(m):
            n = F.conv(digits_of(m), base, 10).try_cast("bigint")
            return F.when(n.between(1, 0x10FFFF), _code_point(n)).otherwise(m)

        return value

    table = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    hex_digits = lambda m: F.regexp_extract(m, "(?i)&#x([0-9a-f]+);", 1)
    dec_digits = lambda m: F.regexp_extract(m, "&#([0-9]+);", 1)
    named = lambda m: F.coalesce(
        F.try_element_at(table, F.lower(F.regexp_extract(m, "&([A-Za-z]+);", 1))), m)
    step1 = lambda t: _replace_each(t, "(?i)&#x[0-9a-f]+;", numeric(hex_digits, 16))
    step2 = lambda t: _replace_each(t, "&#[0-9]+;", numeric(dec_digits, 10))
    step3 = lambda t: _replace_each(t, "&[A-Za-z]+;", named)
    decoded = let(let(let(col(c), step1), step2), step3)
    return F.when(F.contains(col(c), F.lit("&")), decoded).otherwise(col(c))


def tidy_lines(c: Column) -> Column:
    """Blanks collapsed, at most one empty line in a row, ends trimmed."""
    s = F.regexp_replace(c, "\r", "")
    s = F.regexp_replace(s, "[ \t\\u00A0]+", " ")
    s = F.regexp_replace(s, " ?\n ?", "\n")
    s = F.regexp_replace(s, "\n{3,}", "\n\n")
    return F.regexp_replace(s, rx(r"^{S}+|{S}+\z"), "")


def html_to_text(c: Column | str) -> Column:
    """Readable text: list items become "- " lines, blocks become line breaks, scripts and comments go."""
    b = "(?![A-Za-z0-9_])"
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), f"(?is)<(script|style|noscript){b}.*?</\\1>", " ")
    s = F.regexp_replace(s, "(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, rx("<br{S}*/?>", True), "\n")
    s = F.regexp_replace(s, f"(?i)<li{b}[^>]*>", "\n- ")
    s = F.regexp_replace(s, rx("</li{S}*>", True), "")
    s = F.regexp_replace(s, f"(?i)<(?:{BLOCK_TAGS}){b}[^>]*>", "\n")
    s = F.regexp_replace(s, rx("</(?:" + BLOCK_TAGS + "){S}*>", True), "\n")
    s = F.regexp_replace(s, "<[^>]+>", "")
    return let(s, lambda t: tidy_lines(decode_entities(t)))
