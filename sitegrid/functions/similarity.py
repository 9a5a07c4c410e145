"""Similarity of names by matching blocks (Ratcliff and Obershelp, 1988), in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=65_536)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def block_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, 0 to 1; null where a name is. Equal pairs are computed once."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def block_bound(a: Column, b: Column, letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """What the similarity can't exceed: twice the characters the names have in common in any order, over all characters.

    A column expression that spares most pairs the comparison; names in upper case (others are bounded less tightly).
    """
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    rest = lambda t: F.length(F.regexp_replace(t, f"[{letters}]", ""))
    common = F.least(rest(a), rest(b))
    for c in letters:
        common = common + F.least(count(a, c), count(b, c))
    return F.coalesce(2 * common / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(1.0))
