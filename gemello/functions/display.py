"""Terminal columns of text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

TAB = 4


def width(c: str, at: int) -> int:
    """Columns that a character takes at a column: tabs reach the next stop, wide ones take two, marks and controls none."""
    if c == "\t":
        return TAB - at % TAB
    if unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc"):
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def column_at(text: str, offset: int) -> int:
    """The terminal column of a byte offset; one inside a character counts as its start."""
    at = done = 0
    for c in text:
        size = len(c.encode())
        if done + size > offset:
            break
        at += width(c, at)
        done += size
    return at


@F.pandas_udf(IntegerType())
def terminal_column(text: pd.Series, offset: pd.Series) -> pd.Series:
    """The same for columns of texts and offsets."""
    return pd.Series([column_at(t or "", int(o)) for t, o in zip(text, offset, strict=True)])


def fit(text: str, columns: int) -> str:
    """A text cut or filled with blanks to exactly so many columns."""
    at, out = 0, []
    for c in text:
        w = width(c, at)
        if at + w > columns:
            break
        out.append(c)
        at += w
    return "".join(out) + " " * (columns - at)
