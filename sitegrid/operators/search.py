"""Ranked search, filters, sorting and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions.text import has_all_tokens, match_score


def ranked_search(df: DataFrame, name: str, query: str, kind_rank: Column, weight: str, limit: int = 12) -> DataFrame:
    """The best matches: by score, kind, weight (largest first), length of the name, name. A distributed top-k."""
    scored = df.withColumns({"score": match_score(F.col(name), query), "kind_rank": kind_rank}).where(F.col("score") > 0)
    return scored.orderBy(F.desc("score"), F.asc("kind_rank"), F.desc_nulls_last(weight), F.length(name), F.col(name)).limit(limit)


def filtered(df: DataFrame, filters: dict[str, Column], chosen: list[str]) -> DataFrame:
    """Rows that pass all chosen filters of a registry; null fails. Unknown names are an error."""
    unknown = [c for c in chosen if c not in filters]
    if unknown:
        raise KeyError(f"no such filters: {unknown}")
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(filters[c], F.lit(False)) for c in chosen], F.lit(True)))


def page_of(df: DataFrame, order: list[Column], page: int, size: int, query: tuple[str, str] | None = None) -> tuple[DataFrame, int]:
    """A page of the sorted rows, and which it is: numbers outside 1..last are clamped. ``query``: column and words."""
    found = df.where(has_all_tokens(F.col(query[0]), query[1])) if query else df
    last = max(1, -(-found.count() // size))
    at = min(max(1, page), last)
    return found.orderBy(*order).offset((at - 1) * size).limit(size), at


def first_matches(df: DataFrame, condition: Column, ordinal: str, limit: int = 8) -> DataFrame:
    """The first rows in source order that meet the condition."""
    return df.where(condition).orderBy(ordinal).limit(limit)
