"""Drift between two dated states of a table, and series of dated totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def side_by_side(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """``key, side, <m>_t0, <m>_t1``: a full outer join with where each key is found (both, only before, only after)."""
    a = before.select(key, F.lit(True).alias("__a"), *[F.col(m).alias(f"{m}_t0") for m in measures])
    b = after.select(key, F.lit(True).alias("__b"), *[F.col(m).alias(f"{m}_t1") for m in measures])
    side = F.when(F.col("__b").isNull(), "only before").when(F.col("__a").isNull(), "only after").otherwise("both")
    return a.join(b, key, "full_outer").withColumn("side", side).select(key, "side", *[f"{m}_{t}" for m in measures for t in ("t0", "t1")])


def drift_summary(pairs: DataFrame, measures: list[str]) -> DataFrame:
    """``measure, n_both, n_changed, pct_changed, n_from_zero, n_to_zero, net`` over keys found on both sides.

    Null is a value of its own for "changed" and counts as nothing for "net". One pass over the pairs for all measures.
    """
    both = pairs.where("side = 'both'")
    long = both.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_t0").cast("double").alias("a"), F.col(f"{m}_t1").cast("double").alias("b")) for m in measures])))
    changed = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
    return long.groupBy("measure").agg(
        F.count(F.lit(1)).alias("n_both"), changed.alias("n_changed"), F.round(100.0 * changed / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("pct_changed"), F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("n_from_zero"),
        F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("n_to_zero"), F.sum(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("net"),
    )


def series_growth(df: DataFrame, at: str, value: str) -> DataFrame:
    """``at, value, change, pct_growth, days`` against the date before; one row per date, so the window is small."""
    w = Window.partitionBy().orderBy(at)
    before = F.lag(value).over(w)
    return df.select(at, value, (F.col(value) - before).alias("change"), F.round(100.0 * (F.col(value) - before) / F.nullif(before, F.lit(0)), 4).alias("pct_growth"), F.datediff(F.col(at), F.lag(at).over(w)).alias("days"))
