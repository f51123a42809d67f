"""Marks in the place of spans. A text is cut once, so the work is linear in its length and the number of its spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(text: str | None, starts, ends, mark) -> str | None:
    """The text with mark(start, end) in the place of the spans; spans that touch or overlap have one mark together,
    that of the first, the longest of those that begin there."""
    if text is None or starts is None or not len(starts):
        return text
    out, at, first = [], 0, True
    for start, less in sorted(zip(starts, (-e for e in ends))):
        if start > at or first:
            out += [text[at:start], mark(start, -less)]
        at, first = max(at, -less), False
    return "".join([*out, text[at:]])


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with the mask in the place of every span (start, end, in code points)."""
    @F.pandas_udf("string")
    def put(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([cut(t, s, e, lambda *_: mask) for t, s, e in zip(texts, starts, ends)], dtype=object)

    return put(text, spans["start"], spans["end"])
