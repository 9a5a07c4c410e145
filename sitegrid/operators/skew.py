"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most MOST_HOT hot keys.
MOST_HOT = 256
#: Below this many rows a key is never hot: one task takes it with ease.
LEAST_ROWS = 200_000
#: Rows of a hot key for each task; a key is spread over 32 tasks at least, and over as many as its rows ask for.
SALT_ROWS = 500_000


def hot_counts(df: DataFrame, keys: list[str], least_rows: int = LEAST_ROWS) -> dict[tuple, int]:
    """The keys of more than 1/256 of all rows, with their rows; hence at most 256, whatever the data.

    Counting combines on the map side. Null keys take no part in joins and are left out.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counts = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least_rows)
    large = counts.orderBy(F.desc("__n")).limit(MOST_HOT).collect()
    if not large:
        return {}
    total = df.select(keys[0]).count()
    return {tuple(r[k] for k in keys): r["__n"] for r in large if r["__n"] * MOST_HOT >= total}


def hot_keys(df: DataFrame, keys: list[str], least_rows: int = LEAST_ROWS) -> list[tuple]:
    """The keys of :func:`hot_counts` alone."""
    return list(hot_counts(df, keys, least_rows))


def _salts(on: list[str], hot: dict[tuple, int], least: int) -> Column:
    """Parts of a row's key: 1 where it isn't hot."""
    out = F.lit(1)
    for key, n in hot.items():
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(on, key, strict=True)])
        out = F.when(same, F.lit(max(least, -(-n // SALT_ROWS)))).otherwise(out)
    return out


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 32, least_rows: int = LEAST_ROWS, hot: dict[tuple, int] | list[tuple] | None = None, both: bool = False) -> DataFrame:
    """``left`` joined to ``right`` where ``left`` may hold a third of its rows under one key.

    Rows of ``left`` under a hot key are spread over tasks by a hash of the row and of its input partition (so exact copies
    are spread too, and a retried task salts alike), at least ``salts`` of them and as many as the key's rows ask for; the
    rows of ``right`` under that key are repeated for each. With ``both`` (inner joins) a hot key of ``right`` is spread in
    the same way. ``how``: inner, left, left_semi or left_anti. Result rows are those of the plain join. ``hot``: the hot
    keys of ``left``, where they are known already.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"skew_join can't do {how}")
    if both and how != "inner":
        raise ValueError("both sides can be spread in inner joins only")
    hot = hot_counts(left, on, least_rows) if hot is None else hot if isinstance(hot, dict) else dict.fromkeys(hot, 0)
    hot_right = hot_counts(right, on, least_rows) if both else {}
    if not hot and not hot_right:
        return left.join(right, on, how)
    marks = []
    for mark, keys in (("__salt", hot), ("__right_salt", hot_right)):
        if not keys:
            continue
        marks.append(mark)
        parts = _salts(on, keys, salts)
        spread, copies = (left, right) if mark == "__salt" else (right, left)
        spread = spread.withColumn(mark, F.pmod(F.xxhash64(*spread.columns, F.spark_partition_id()), parts).cast("int"))
        copies = copies.withColumn(mark, F.explode(F.sequence(F.lit(0), parts - 1)))
        left, right = (spread, copies) if mark == "__salt" else (copies, spread)
    return left.join(right, [*on, *marks], how).drop(*marks)
