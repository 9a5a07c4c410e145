"""Bands and classes: generated CASE chains over declared bounds, and ordinal codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold_band(value: Column, bounds: Sequence[tuple[float, str]], beyond: str, missing: str | None = None) -> Column:
    """The label of the first bound the value doesn't exceed, ``beyond`` above all; null gives ``missing``.

    Every value up to the last bound has a band, whether or not it is listed: bounds are walked, not looked up.
    """
    out = F.lit(beyond)
    for bound, label in reversed(list(bounds)):
        out = F.when(value <= bound, F.lit(label)).otherwise(out)
    return F.when(value.isNull(), F.lit(missing)).otherwise(out)


def right_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Labels of (edge i, edge i + 1]; outside all edges and for null: null."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def half_open(value: Column, bands: Sequence[tuple[float, float, str]]) -> Column:
    """Labels of [low, high); a value below or above every band has none (it isn't put in the last one)."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(bands)):
        out = F.when((value >= low) & (value < high), F.lit(label)).otherwise(out)
    return out


def recode(value: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """The table's entry for the value; others (and null) get the default."""
    chain = F.lit(default)
    for source, target in reversed(list(table.items())):
        chain = F.when(value == source, F.lit(target)).otherwise(chain)
    return chain


def first_rule(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(default)
    for condition, label in reversed(list(rules)):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def ordinal(value: Column, order: Sequence[str]) -> Column:
    """1-based place in a declared order; null for null and for labels that aren't in it."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0)).cast("int")


def band_histogram(df: DataFrame, band: str, order: Sequence[str]) -> DataFrame:
    """``ord, band, n, pct`` for each declared band, with 0 for bands without rows; rows without a band aren't counted."""
    counts = df.where(F.col(band).isNotNull()).groupBy(F.col(band).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    declared = df.sparkSession.createDataFrame([(i + 1, b) for i, b in enumerate(order)], "ord int, band string")
    joined = declared.join(counts, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = joined.agg(F.sum("n").alias("t"))
    return joined.join(F.broadcast(total)).select("ord", "band", "n", F.round(100.0 * F.col("n") / F.nullif(F.col("t"), F.lit(0)), 2).alias("pct"))


def bit_flags(flags: Sequence[Column]) -> Column:
    """Flags as one integer: flag i adds 2**i; null is no."""
    out = F.lit(0)
    for i, flag in enumerate(flags):
        out = out + F.when(flag, F.lit(1 << i)).otherwise(F.lit(0))
    return out.cast("int")


def ramp(value: Column, low: float, high: float) -> Column:
    """Linear place between two bounds, clamped to 0..1; null stays null; equal bounds give 0.5."""
    if low == high:
        return F.when(value.isNotNull(), F.lit(0.5))
    return F.when(value.isNotNull(), F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)))
