"""Exact quantiles of any number of groups, from counts by value and ranged running totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.session import written

#: Parts of a measure's values; only the parts that hold a wanted rank are ordered.
PARTS = 64


def same_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns of which a null equals a null; the columns are those of ``left``."""
    if not on:
        return left.join(right, how="left" if how == "left" else "inner")
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in on})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"__right_{c}" for c in on])


def part_of(value: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted cuts a value reaches, as a tree of comparisons."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(value < F.lit(cuts[middle]), part_of(value, cuts[:middle], first)).otherwise(part_of(value, cuts[middle + 1 :], first + middle + 1))


def quantiles(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], qs: Sequence[float], nearest: bool = False) -> DataFrame:
    """``by..., measure, q, value, n``: exact quantiles of the non-null values of each measure in each group.

    Interpolated between neighbours, or with ``nearest`` the element floor(n * q) counted from 0 (the last at most). Rows
    are counted by value with map-side combine and written; the values of a measure are cut into PARTS ranges, whose counts
    give each range's place; only the ranges that hold a wanted rank are ordered, each by itself. So no task holds a group,
    nor all its distinct values. Null group keys are a group; NaN counts as missing; groups without values have no row.
    """
    by, names = list(by), list(values)
    structs = F.array(*[F.struct(F.lit(k).alias("__m"), v.cast("double").alias("__v")) for k, v in values.items()])
    long = df.select(*by, F.inline(structs)).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = written(long.groupBy(*by, "__m", "__v").agg(F.count(F.lit(1)).alias("__n")), "value-counts")
    cuts = {r["__m"]: sorted(set(r["c"])) for r in counts.groupBy("__m").agg(F.percentile_approx("__v", [i / PARTS for i in range(1, PARTS)], 1000).alias("c")).collect()}
    part = F.lit(0)
    for m in names:
        if cuts.get(m):
            part = F.when(F.col("__m") == m, part_of(F.col("__v"), cuts[m])).otherwise(part)
    keys = [*by, "__m"]
    parted = counts.withColumn("__part", part)
    sums = parted.groupBy(*keys, "__part").agg(F.sum("__n").alias("__s"))
    whole = Window.partitionBy(*keys)
    placed = sums.withColumns({"__before": F.sum("__s").over(whole.orderBy("__part")) - F.col("__s"), "__total": F.sum("__s").over(whole)})
    wanted = placed.withColumn("__q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    at = F.least(F.floor(F.col("__total") * F.col("__q")), F.col("__total") - 1) if nearest else F.col("__q") * (F.col("__total") - 1)
    wanted = wanted.withColumn("__at", at).withColumns({"__low": F.floor("__at"), "__high": F.ceil("__at")})
    holds = lambda rank, start, n: (F.col(rank) >= start) & (F.col(rank) < start + n)
    wanted = wanted.where(holds("__low", F.col("__before"), F.col("__s")) | holds("__high", F.col("__before"), F.col("__s")))
    ranges = wanted.select(*keys, "__part", "__before").distinct()
    inner = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = same_keys(parted, ranges, [*keys, "__part"]).withColumn("__start", F.col("__before") + F.sum("__n").over(inner) - F.col("__n")).drop("__before")
    found = same_keys(ordered, wanted.select(*keys, "__part", "__q", "__at", "__low", "__high", "__total"), [*keys, "__part"])
    hit = lambda rank: F.max(F.when(holds(rank, F.col("__start"), F.col("__n")), F.col("__v")))
    ends = found.groupBy(*keys, "__q").agg(hit("__low").alias("__a"), hit("__high").alias("__b"), F.max("__at").alias("__at"), F.max("__total").alias("n"))
    value = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__at") - F.floor("__at"))
    return ends.select(*by, F.col("__m").alias("measure"), F.col("__q").alias("q"), value.alias("value"), "n")


def with_quantiles(groups: DataFrame, df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[Column, float]], digits: int = 4) -> DataFrame:
    """``groups`` (one row per ``by``) with a column for each of ``wanted``: the quantile of a value among the rows of ``df``."""
    by = list(by)
    found = quantiles(df, by, {k: v for k, (v, _) in wanted.items()}, sorted({q for _, q in wanted.values()}))
    wide = found.groupBy(*by).agg(*[F.max(F.when((F.col("measure") == k) & (F.col("q") == q), F.round("value", digits))).alias(k) for k, (_, q) in wanted.items()])
    return same_keys(groups, wide, by, "left")
