"""Measures with one definition at every level: counts, shares with explicit denominators, classes and rollups."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_sum(c: Column | str) -> Column:
    """A sum of integers that can't overflow (a plain sum of bigint raises an error in ANSI mode)."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)"))


def share(hit: Column, known: Column | None = None, digits: int = 2) -> Column:
    """Percent of hits among rows where ``known`` holds (by default: where ``hit`` isn't null); null if there are none."""
    known = hit.isNotNull() if known is None else known
    return F.round(100.0 * F.count_if(hit & known) / F.nullif(F.count_if(known), F.lit(0)), digits)


def share_of_all(hit: Column, digits: int = 2) -> Column:
    """Percent of hits among all rows: for measures whose null is itself a finding and belongs in the numerator."""
    return F.round(100.0 * F.count_if(hit) / F.nullif(F.count(F.lit(1)), F.lit(0)), digits)


def class_shares(family: str, classes: Iterable[str], column: Column | str | None = None, digits: int = 2) -> list[Column]:
    """A percent-of-known column ``<family>_share_<class>`` for every class."""
    c = F.col(f"{family}_class") if column is None else F.col(column) if isinstance(column, str) else column
    return [share(c == cls, c.isNotNull(), digits).alias(f"{family}_share_{cls}") for cls in classes]


def three_state(linked: Column, positive: Column) -> Column:
    """Null where nothing is linked, else whether it is positive (false where linked and null)."""
    return F.when(~linked, F.lit(None).cast("boolean")).otherwise(F.coalesce(positive, F.lit(False)))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0))


def either_sum(a: Column, b: Column) -> Column:
    """The sum of two shares: null only where both are."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


@dataclass(frozen=True)
class Measure:
    """A measure of a row and of a group: ``known`` rows count, of which those that ``test`` are hits."""

    name: str
    known: Column
    test: Column

    def columns(self) -> list[Column]:
        return [F.count_if(self.known & self.test).alias(f"{self.name}_hits"), F.count_if(self.known).alias(f"{self.name}_known")]


def summarise(df: DataFrame, by: list[str], measures: list[Measure]) -> DataFrame:
    """Members, hits, known and percent of each measure per group; no known member gives a null percent, never 0."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), *[c for m in measures for c in m.columns()])
    return out.withColumns({f"{m.name}_pct": F.round(100.0 * F.col(f"{m.name}_hits") / F.nullif(F.col(f"{m.name}_known"), F.lit(0)), 2) for m in measures})


def rollup_levels(df: DataFrame, levels: dict[str, list[str]], measures: list[Column], key: str = "key") -> DataFrame:
    """The same measures at several levels: ``level, key, <measures>``.

    ``levels``: name and columns that identify a group; a level of no columns is the whole. One pass (grouping sets
    with partial aggregation) however many levels; keys of several columns are joined by " / ".
    """
    columns = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    position = {c: len(columns) - 1 - i for i, c in enumerate(columns)}
    grouped = df.groupingSets([[F.col(c) for c in cols] for cols in levels.values()], *columns).agg(F.grouping_id().alias("__gid"), *measures)
    full = (1 << len(columns)) - 1
    level, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, cols in levels.items():
        gid = full - sum(1 << position[c] for c in cols)
        level = F.when(F.col("__gid") == gid, F.lit(name)).otherwise(level)
        label = F.when(F.col("__gid") == gid, F.concat_ws(" / ", *[F.col(c).cast("string") for c in cols]) if cols else F.lit("all")).otherwise(label)
    names = [c for c in grouped.columns if c not in (*columns, "__gid")]
    return grouped.select(level.alias("level"), label.alias(key), *names)
