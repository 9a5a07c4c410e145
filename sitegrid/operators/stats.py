"""Ranks, rank correlation, and null models by repeatable draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrid.operators.ranks import part_of, quantiles, with_quantiles
from sitegrid.operators.skew import skew_join

#: Parts of the order in which running totals are taken side by side.
PARTS = 64
#: A multiplicative congruential generator modulo a Mersenne prime (Park and Miller), and a mixing factor.
MODULUS, MULTIPLIER, MIX = 2_147_483_647, 48_271, 1_103_515_245


def running_total(df: DataFrame, by: list[str], order: str, value: str, name: str, parts: int = PARTS) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group before it in ``order`` (unique within the group).

    No window spans a group: quantiles of ``order`` cut it into parts, whose sums are added up first.
    """
    cuts = sorted(set(df.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01))) if dict(df.dtypes)[order] not in ("string", "boolean") else []
    cut = df.withColumn("__part", part_of(F.col(order), cuts))
    sums = cut.groupBy(*by, "__part").agg(F.sum(value).alias("__s"))
    before = sums.select(*by, "__part", (F.sum("__s").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__s")).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return cut.withColumn("__inside", inside).join(before, [*by, "__part"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside")


def places_nulls_last(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` with ``up`` and ``down``: the place of each row by ``value`` from the least and from the greatest, ties by the
    unique ``key``; nulls are last in both.

    Distinct values are counted and their counts added over parts of the order; rows of one value are numbered over
    parts of the key. No window spans all rows, nor all rows of a value.
    """
    rows = df.withColumns({"__known": F.col(value).isNotNull(), "__v": F.coalesce(value, F.lit(0).cast(df.schema[value].dataType)), "__one": F.lit(1).cast("bigint")})
    counts = rows.where("__known").groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
    total = F.lit(counts.agg(F.sum("__n")).first()[0] or 0).cast("bigint")
    known = running_total(counts, [], "__v", "__n", "__b").select(F.lit(True).alias("__known"), "__v", F.col("__b").alias("__up"), (total - F.col("__b") - F.col("__n")).alias("__down"))
    last = df.sparkSession.range(1).select(F.lit(False).alias("__known"), F.lit(0).cast(df.schema[value].dataType).alias("__v"), total.alias("__up"), total.alias("__down"))
    within = running_total(rows, ["__known", "__v"], key, "__one", "__k")
    placed = skew_join(within, known.union(last), ["__known", "__v"])
    return placed.select(*df.columns, *[(F.col(f"__{d}") + F.col("__k") + 1).alias(d) for d in ("up", "down")])


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``by..., value, n, <name>``: the mean rank of each distinct non-null value among the rows of its group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, by or [], value, "n", "__b").select(*(by or []), value, "n", (F.col("__b") + (F.col("n") + 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """``by..., rho, n``: rank correlation with mean ranks on ties over rows where both are known.

    Equal pairs are united first, so a zero that half the rows share is one row; the correlation is of weighted pairs.
    Fewer than two rows or a constant give null.
    """
    by = by or []
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("w"))
    expanded = [pairs.groupBy(*by, c).agg(F.sum("w").alias("n")) for c in (x, y)]
    ranked = pairs
    for c, counts, name in ((x, expanded[0], "rx"), (y, expanded[1], "ry")):
        ranks = running_total(counts, by, c, "n", "__b").select(*by, c, (F.col("__b") + (F.col("n") + 1) / 2).alias(name))
        ranked = skew_join(ranked, ranks, [*by, c])
    s = lambda c: F.sum(F.col("w") * c)
    rx, ry = F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*by).agg(F.sum("w").alias("n"), s(rx).alias("sx"), s(ry).alias("sy"), s(rx * ry).alias("sxy"), s(rx * rx).alias("sxx"), s(ry * ry).alias("syy"))
    n = F.col("n")
    spread = F.sqrt((n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2))
    return sums.select(*by, F.round((n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(spread, F.lit(0.0)), 6).alias("rho"), "n")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def two_sided_p(rho: float, n: int) -> float:
    """Probability of a rank correlation at least as far from 0, from Student's t with n - 2 degrees of freedom."""
    if n < 3:
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    x = df / (df + rho * rho * df / (1 - rho * rho))
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x < 1 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of rho for n rows; null for a null rho."""
    return pd.Series([None if pd.isna(r) else two_sided_p(float(r), int(k)) for r, k in zip(rho, n, strict=True)], dtype=float)


def uniform(i: Column, draw: Column | int) -> Column:
    """A repeatable pseudo-random integer below MODULUS for item i of a draw: the same in any engine and partition."""
    draw = F.lit(draw) if isinstance(draw, int) else draw
    mixed = F.pmod(i.cast("bigint") * MIX + draw.cast("bigint") * 7_919 + 12_345, F.lit(MODULUS))
    twice = F.pmod(mixed * MULTIPLIER, F.lit(MODULUS))
    return F.pmod(twice * MULTIPLIER, F.lit(MODULUS))


def weighted_draws(items: DataFrame, order: str, weight: str, draws: DataFrame, buckets: int = 1024) -> DataFrame:
    """``draw, i, <items' columns>``: an item with probability in proportion to its integer weight for every row of ``draws(draw, i)``.

    Items lie end to end in ``order`` (unique, numeric); a draw's uniform number falls into one of them. The range join
    is an equal join on stretches of the line, into which items are cut. Items without a positive weight are never
    drawn; without any, there are no rows.
    """
    able = items.where(F.col(weight) > 0)
    total = able.agg(F.sum(weight)).collect()[0][0]
    if not total:
        return draws.join(items, F.lit(False))
    width = max(1, -(-int(total) // buckets))
    placed = running_total(able, [], order, weight, "__low").withColumn("__high", F.col("__low") + F.col(weight))
    spread = placed.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor((F.col("__high") - 1) / width))))
    drawn = draws.withColumn("__u", F.pmod(uniform(F.col("i"), F.col("draw")), F.lit(int(total)))).withColumn("__bucket", F.floor(F.col("__u") / width))
    met = drawn.join(spread, "__bucket").where((F.col("__u") >= F.col("__low")) & (F.col("__u") < F.col("__high")))
    return met.drop("__bucket", "__u", "__low", "__high")


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Inner edges of equal-count bins of the non-null values (exact quantiles), without repeats."""
    return sorted({r["value"] for r in quantiles(df, [], {"v": F.col(value)}, [i / bins for i in range(1, bins)]).collect()})


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the bin (low, high] of a value: how many edges lie below it; null for null."""
    out = F.lit(0)
    for e in edges:
        out = out + (value > e).cast("int")
    return out


def matched_draws(targets: DataFrame, pool: DataFrame, value: str, order: str, draw: int = 0, bins: int = 10) -> DataFrame:
    """``i, bin, <order>``: for each target row (``i``, ``value``) a row of ``pool`` from the same bin of the targets' values.

    Pool rows of a bin are numbered in ``order`` (unique); a target takes the one its uniform number points to. Targets
    whose bin has no pool row are left out.
    """
    edges = quantile_edges(targets, value, bins)
    goals = targets.where(F.col(value).isNotNull()).select("i", bin_of(F.col(value), edges).alias("bin"))
    rows = pool.where(F.col(value).isNotNull()).select(order, bin_of(F.col(value), edges).alias("bin"), F.lit(1).alias("one"))
    numbered = running_total(rows, ["bin"], order, "one", "slot").drop("one")
    sizes = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))  # a row per bin
    return goals.join(F.broadcast(sizes), "bin").withColumn("slot", F.pmod(uniform(F.col("i"), draw), F.col("size"))).join(numbered, ["bin", "slot"]).select("i", "bin", order)


def envelope(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by..., mean, lo95, hi95, n`` over redraws: mean and the 2.5 and 97.5 percentiles."""
    groups = df.groupBy(*by).agg(F.round(F.avg(value), 4).alias("mean"), F.count(value).alias("n"))
    return with_quantiles(groups, df, by, {"lo95": (F.col(value), 0.025), "hi95": (F.col(value), 0.975)}).select(*by, "mean", "lo95", "hi95", "n")
