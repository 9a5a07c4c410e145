"""Profiles of a table: zeros, concentration, cross-tabs, distributions and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.operators.ranks import quantiles, with_quantiles


def long_form(df: DataFrame, ids: list[str], columns: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """Wide to long; values as double."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, name, value)


def zero_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, n_known, n_null, n_zero, pct_zero, n_positive`` of each column, in one pass."""
    long = long_form(df, [], columns)
    known = F.col("value").isNotNull()
    return long.groupBy("field").agg(F.count_if(known).alias("n_known"), F.count_if(~known).alias("n_null"), F.count_if(F.col("value") == 0).alias("n_zero"), F.round(100.0 * F.count_if(F.col("value") == 0) / F.nullif(F.count_if(known), F.lit(0)), 2).alias("pct_zero"), F.count_if(F.col("value") > 0).alias("n_positive"))


def concentration(df: DataFrame, value: str, tops: Sequence[int], tie: list[Column | str]) -> DataFrame:
    """``top_n, share``: percent of the total held by the n largest rows, for each n.

    Only the largest max(tops) rows are ranked (a distributed top-k); the total is an aggregate.
    """
    if not tops:
        raise ValueError("no tops")
    order = [F.desc_nulls_last(value), *tie]
    head = df.where(F.col(value).isNotNull()).orderBy(*order).limit(max(tops)).withColumn("rn", F.row_number().over(Window.partitionBy().orderBy(*order)))
    total = df.agg(F.sum(value).alias("total"))
    sums = head.agg(*[F.sum(F.when(F.col("rn") <= n, F.col(value))).alias(str(n)) for n in tops])
    long = sums.unpivot([], [str(n) for n in tops], "top_n", "s").join(F.broadcast(total))
    return long.select(F.col("top_n").cast("int").alias("top_n"), F.round(100.0 * F.col("s") / F.nullif(F.col("total"), F.lit(0)), 2).alias("share"))


def crosstab(df: DataFrame, a: Column, b: Column, names: tuple[str, str]) -> DataFrame:
    """Counts of two conditions' combinations with percent of all; null counts as false. Absent cells are absent."""
    cells = df.select(F.coalesce(a, F.lit(False)).alias(names[0]), F.coalesce(b, F.lit(False)).alias(names[1])).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # four rows at most


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n, pct``, nulls included."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return counts.join(F.broadcast(total)).select("value", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("pct"))


def modes(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """``by..., mode, n``: the most frequent non-null value, the smallest on a tie. Counted in two stages."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("mode"))).alias("b")
    return counts.groupBy(*by).agg(best).select(*by, "b.mode", (-F.col("b.m")).alias("n"))


def pivot_share(df: DataFrame, row: str, column: str, values: Sequence[str], weight: str) -> DataFrame:
    """Percent of each row's weight by column value; listed values only, so the plan needs no extra job."""
    wide = df.groupBy(row).agg(F.sum(weight).alias("total"), *[F.sum(F.when(F.col(column) == v, F.col(weight)).otherwise(0)).alias(v) for v in values])
    return wide.select(row, *[F.round(100.0 * F.col(v) / F.nullif(F.col("total"), F.lit(0)), 2).alias(v) for v in values])


def top_item(df: DataFrame, by: list[str], item: str, weight: str) -> DataFrame:
    """``by..., item, weight, pct``: the item with the largest summed weight (least item on a tie) and its share."""
    sums = df.groupBy(*by, item).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(*by).agg(F.min(F.struct((-F.col("w")).alias("m"), F.col(item).alias("i"))).alias("b"), F.sum("w").alias("t"))
    return best.select(*by, F.col("b.i").alias(item), F.round(-F.col("b.m"), 2).alias(weight), F.round(-100.0 * F.col("b.m") / F.nullif(F.col("t"), F.lit(0)), 2).alias("pct"))


def percentiles(df: DataFrame, value: Column, qs: Sequence[float], where: Column | None = None) -> DataFrame:
    """Exact interpolated percentiles: ``q, value, n``."""
    return quantiles(df if where is None else df.where(where), [], {"v": value}, qs).select("q", F.round("value", 4).alias("value"), "n")


def nearest_rank(df: DataFrame, by: list[str], value: str, quantile: float) -> DataFrame:
    """``by..., value``: element floor(n * q) of the sorted non-null values (counted from 0, the last at most), as double."""
    return quantiles(df, by, {value: F.col(value)}, [quantile], nearest=True).select(*by, F.col("value").alias(value))


def constant_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, n_distinct, is_constant``: null counts as no value."""
    wide = df.agg(*[F.count_distinct(F.col(c).cast("string")).alias(c) for c in columns])
    return wide.unpivot([], columns, "field", "n_distinct").withColumn("is_constant", F.col("n_distinct") <= 1)


def integrity(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``check, n_rows, n_broken``: rows where the two sides differ (null and null are equal)."""
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~a.eqNullSafe(b)).alias(k) for k, (a, b) in checks.items()])
    return wide.unpivot(["n_rows"], list(checks), "check", "n_broken").select("check", "n_rows", "n_broken")


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """``step, label, n``: rows that pass the step and all before it; null fails."""
    passed, columns = F.lit(True), []
    for label, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        columns.append((label, F.count_if(passed)))
    wide = df.agg(*[c.alias(label) for label, c in columns])
    labels = [label for label, _ in columns]
    return wide.unpivot([], labels, "label", "n").withColumn("step", F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int")).select("step", "label", "n")


def within_thresholds(df: DataFrame, distance: Column, thresholds: Sequence[float]) -> DataFrame:
    """``threshold, n, pct``: rows at most that far, of all rows (a null distance is beyond every threshold)."""
    names = [f"{t:g}" for t in thresholds]
    wide = df.agg(F.count(F.lit(1)).alias("t"), *[F.count_if(distance <= t).alias(n) for t, n in zip(thresholds, names, strict=True)])
    return wide.unpivot(["t"], names, "threshold", "n").select(F.col("threshold").cast("double").alias("threshold"), "n", F.round(100.0 * F.col("n") / F.nullif(F.col("t"), F.lit(0)), 2).alias("pct"))


def standardised_rate(df: DataFrame, stratum: str, hit: Column, weights: DataFrame, weight: str) -> DataFrame:
    """One row ``crude, standardised``: percent of hits, and the strata's percents weighted by another population."""
    rates = df.groupBy(stratum).agg((100.0 * F.avg(F.coalesce(hit, F.lit(False)).cast("int"))).alias("rate"), F.count(F.lit(1)).alias("n"))
    joined = rates.join(weights.groupBy(stratum).agg(F.sum(weight).alias("w")), stratum)
    return joined.agg(F.round(F.sum(F.col("rate") * F.col("n")) / F.sum("n"), 4).alias("crude"), F.round(F.sum(F.col("rate") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0)), 4).alias("standardised"))


def dense_groups(df: DataFrame, group: str, fraction: float) -> DataFrame:
    """Rows of groups with at least ``fraction`` of the median group's rows."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    middle = quantiles(sizes, [], {"n": F.col("__n")}, [0.5]).select("value")
    kept = sizes.join(F.broadcast(middle)).where(F.col("__n") >= fraction * F.col("value")).select(group)  # one row
    return df.join(kept, group, "left_semi")


def error_stats(df: DataFrame, estimate: Column, exact: Column, tolerance: float) -> DataFrame:
    """One row: ``n, median_error, median_abs_error, p90_abs_error, pct_within`` of two estimators where both are known."""
    rows = df.select((estimate - exact).alias("e")).where(F.col("e").isNotNull())
    e = F.col("e")
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.abs(e) <= tolerance) / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("pct_within"))
    return with_quantiles(one, rows, [], {"median_error": (e, 0.5), "median_abs_error": (F.abs(e), 0.5), "p90_abs_error": (F.abs(e), 0.9)}).select("n", "median_error", "median_abs_error", "p90_abs_error", "pct_within")
