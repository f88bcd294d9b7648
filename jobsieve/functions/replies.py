"""Reading model replies: text of a reply body, reasoning stripped, first JSON object, values by type."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsieve.functions.text import col, or_empty, squash

# The tags that wrap a model's thinking.
_TAGS = "think|thinking|reasoning"


def reply_text(body: Column | str) -> Column:
    """Text of a reply body: string content, an array of parts, or the older ``text`` key; else empty."""
    b = col(body)
    message = lambda kind: F.get_json_object(b, f"$.choices[0].{kind}")
    content = message("message.content")
    doc = F.try_parse_json(b)
    kind = F.schema_of_variant(F.try_variant_get(doc, "$.choices[0].message.content", "variant"))
    parts = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: or_empty(p["text"])), "")
    older = F.try_variant_get(doc, "$.choices[0].text", "variant")
    return or_empty(
        F.when(kind == "STRING", content)
        .when(F.startswith(kind, F.lit("ARRAY")), joined)
        .when(F.schema_of_variant(older) == "STRING", message("text")))


def strip_reasoning(c: Column | str) -> Column:
    """Drop reasoning blocks; one that never closes takes the rest of the reply with it."""
    s = F.regexp_replace(or_empty(c), f"(?is)<({_TAGS})>.*?</\\1>", " ")
    s = F.regexp_replace(s, f"(?i)</(?:{_TAGS})>", " ")
    return F.regexp_replace(s, f"(?is)<(?:{_TAGS})>.*\\z", "")



def _first_object(s: str | None) -> str | None:
    start = (s or "").find("{")
    if start < 0:
        return None
    depth, quote, skip = 0, "", -1
    for m in re.compile(r"[\\\"'{}]").finditer(s, start):
        at, ch = m.start(), m.group()
        if at == skip:
            continue
        if quote:
            if ch == "\\":
                skip = at + 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'":
            quote = ch
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                return s[start:at + 1]
    return None


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    """The first brace-matched object, strings and escapes respected; null when none is complete."""
    return text.map(_first_object)


def stated_value(doc: Column, key: str) -> Column:
    """A string (squashed) or a number (as text) under ``key``; anything else null."""
    v = F.try_variant_get(doc, f"$.{key}", "variant")
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(doc, f"$.{key}", "string")
    number = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(kind == "STRING", F.nullif(squash(text), F.lit(""))).when(
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number)
