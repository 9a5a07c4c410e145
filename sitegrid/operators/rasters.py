"""Small rasters held as arrays: windows, majority classes and relief."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_values(rasters: DataFrame, key: str, values: str, width: int, row: int, col: int, reach: int) -> DataFrame:
    """``key, i, v`` of the cells of a square window around (row, col) of each row-major raster; outside cells are absent."""
    cells = [(r, c) for r in range(row - reach, row + reach + 1) for c in range(col - reach, col + reach + 1) if r >= 0 and 0 <= c < width]
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.try_element_at(values, F.lit(r * width + c + 1)).cast("double").alias("v")) for i, (r, c) in enumerate(cells)])
    return rasters.select(key, F.inline(spots)).where(F.col("v").isNotNull())


def majority(values: DataFrame, key: str, label: str, order: str = "i") -> DataFrame:
    """``key, <label>, n, pct``: the most frequent label of a window; on a tie the one seen first."""
    counts = values.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", label)).alias("b"), F.sum("n").alias("t"))
    return best.select(key, F.col(f"b.{label}").alias(label), (-F.col("b.m")).alias("n"), F.round(-100.0 * F.col("b.m") / F.col("t"), 2).alias("pct"))


def relief(values: DataFrame, key: str) -> DataFrame:
    """``key, relief``: greatest less least value of a window."""
    return values.groupBy(key).agg(F.round(F.max("v") - F.min("v"), 6).alias("relief"))
