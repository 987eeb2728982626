"""Text operations on UTF-16 offsets, as Arrow-batched functions.

Chat platforms count offsets and limits in UTF-16 units; these two helpers cut
and measure in those units, which Column functions cannot."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SUMMARY_MAX
from .text import col

_LINK = re.compile(r"\[[^\]]*\]\(#\d+\)")
_HREF = T.StructType([T.StructField("id", T.LongType()), T.StructField("href", T.StringType())])
_TOKENS = T.StructType([T.StructField("body", T.StringType()), T.StructField("links", T.ArrayType(_HREF))])
_BLANK = "\t\n\x0b\x0c\r \xa0                　﻿"


def _units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _cut(text: str, start: int, end: int) -> str:
    """A cut within a surrogate pair gives a replacement character, as encoders do."""
    return text.encode("utf-16-le", "surrogatepass")[2 * start : 2 * end].decode("utf-16-le", "replace")


def clamp(text: str, most: int = SUMMARY_MAX) -> str:
    """Short texts as they are; others end at a space, before a cut link, with …"""
    if _units(text) <= most:
        return text
    head = _cut(text, 0, most)
    space = head.rfind(" ")
    end = space if space > 0 else len(_cut(text, 0, most - 1))
    for link in _LINK.finditer(text):
        if link.start() < end < link.end():
            end = link.start()
    return text[:end].rstrip(_BLANK) + "…"


@F.pandas_udf(T.StringType())
def _clamped(texts: pd.Series) -> pd.Series:
    return texts.map(clamp, na_action="ignore")


def clamp_head(texts, most: int = SUMMARY_MAX) -> Column:
    """As much of a text as clamp() looks at: one character more than fit, and the rest
    of a link that is cut there, which only a [ before it can begin."""
    head = F.substring(col(texts), 1, most + 1)
    link = rf"(?s)^.{{0,{most + 1}}}(?:[^\]]*+\]\(#\d+\)|\(#\d+\)|#?\d+\)|\))?"
    return F.when(F.contains(head, F.lit("[")), F.regexp_extract(col(texts), link, 0)).otherwise(head)


def clamp_summary(texts) -> Column:
    """clamp() over the heads of texts: whole ones need not leave the JVM."""
    return _clamped(clamp_head(texts))


def tokenise(text: str, spans: list[dict]) -> tuple[str, list[dict]]:
    """URL spans (offset, length, url in UTF-16 units) become [label](#N) tokens
    with numbered links; a span that overlaps the one before is skipped."""
    out, links, at = [], [], 0
    for span in sorted(spans, key=lambda s: s["offset"]):
        if span["offset"] < at:
            continue
        stop = span["offset"] + span["length"]
        links.append({"id": len(links) + 1, "href": span["url"]})
        out += [_cut(text, at, span["offset"]), f"[{_cut(text, span['offset'], stop)}](#{len(links)})"]
        at = stop
    return "".join(out) + _cut(text, at, _units(text)), links


@F.pandas_udf(_TOKENS)
def tokenise_links(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = [tokenise(t or "", [dict(s) for s in (x if x is not None else [])]) for t, x in zip(texts, spans)]
    return pd.DataFrame(rows, columns=["body", "links"])
