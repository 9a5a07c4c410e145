"""The N highest-scoring items of every group, from score bands read from the top."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.operators.skew import skew_join
from sitegrid.session import dropped, written

#: Shares of all rows in the bands from the top, each twice the one before, and the rest.
BANDS = 6
#: Parts into which a group's rows of a band are cut before they are ranked exactly. Every task keeps n rows of a group and
#: part before it sends them (a limit pushed into the window), so a part is n rows per task however large the group is.
SALTS = 32


def latest_of(df: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """The row of each key with the latest ``at`` (null is the oldest; further ties go to the largest values).

    Rows without a key are left out; one aggregation with map-side combine.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(at).alias("__at"), *keep)).alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in keep])


def band_edges(df: DataFrame, score: str, bands: int = BANDS, error: float = 0.001) -> list[float]:
    """Lower edges of the score bands from the top: quantiles of all rows, at which the top band has the smallest share.

    The quantiles come from a distributed sketch; any edges give the same result, good ones only make bands even.
    """
    smallest = 1 / (2**bands - 1)
    shares = [1 - smallest * (2 ** (b + 1) - 1) for b in range(bands - 1)]
    edges = df.stat.approxQuantile(score, shares, error) if shares else []
    return sorted({float(e) for e in edges}, reverse=True)


def top_n(df: DataFrame, group: list[str], n: int, order: list[tuple[str, str]], key: str, bands: int = BANDS, salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``: ``group..., key, <order columns>, rank``.

    ``order``: (column, "desc" or "asc") by importance, nulls last in both directions; ``key`` breaks further ties
    upwards, so with unique keys the order is total (equal keys that tie throughout are ranked in any order, as copies
    are alike). The first column is the score: numeric and descending; rows without one (null or NaN) have no rank. Null
    group values form a group of their own.

    The rows are written once for the bands' edges and once split by bands. Bands are read from the top; a band's rows of groups that
    are already full are removed by an anti-join, those of the others are kept, and groups that now have ``n`` are full.
    A group's last band may hold more than it needs: it is cut by an exact ranking, first within ``salts`` parts of the
    group, of which each keeps ``n``, then among those. So neither a group of any size nor a tie of any length is sorted
    in one task, and rows of filled groups are dropped before they are ranked.
    """
    score, direction = order[0]
    if direction != "desc":
        raise ValueError("the score is ranked downwards")
    columns = list(dict.fromkeys([*group, key, *[c for c, _ in order]]))
    marks = [f"__g{i}" for i in range(len(group))]
    # a null group value can't be joined on: it becomes a marked text
    rows = df.select(*columns).where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).withColumns({m: F.coalesce(F.concat(F.lit("v"), F.col(g).cast("string")), F.lit("null")) for m, g in zip(marks, group, strict=True)})
    rows = written(rows, "scored-rows")  # read for the edges and for the bands
    # -inf stands below every edge, so band numbers cover all scores
    edges = band_edges(rows.select(F.col(score).cast("double").alias(score)), score, bands)
    band = F.lit(0)
    for e in edges:
        band = band + (F.col(score) < F.lit(e)).cast("int")
    stored = written(rows.withColumn("__band", band), "score-bands", ["__band"])
    dropped(rows)

    def ranking(*by: str | Column) -> Column:
        keys = [F.desc_nulls_last(c) if d == "desc" else F.asc_nulls_last(c) for c, d in order]
        return F.row_number().over(Window.partitionBy(*by).orderBy(*keys, F.asc_nulls_last(key)))

    kept: list[DataFrame] = []
    counts: DataFrame | None = None
    for b in range(len(edges) + 1):
        part = stored.where(F.col("__band") == b).drop("__band")
        if counts is not None:
            part = skew_join(part, counts.where(F.col("__have") >= n).select(*marks), marks, "left_anti")
        salted = part.withColumn("__salt", F.pmod(F.xxhash64(key, *[c for c, _ in order]), F.lit(salts)))
        best = written(salted.withColumn("__r", ranking(*marks, "__salt")).where(F.col("__r") <= n).drop("__salt", "__r"), f"score-band-{b}")
        kept.append(best)
        if b < len(edges):
            have = best.groupBy(*marks).agg(F.count(F.lit(1)).alias("__have"))
            before, counts = counts, have if counts is None else counts.unionByName(have).groupBy(*marks).agg(F.sum("__have").alias("__have"))
            counts = written(counts, f"group-counts-{b}")
            if before is not None:
                dropped(before)
    dropped(stored, *([counts] if counts is not None else []))
    return reduce(DataFrame.unionByName, kept).withColumn("rank", ranking(*marks)).where(F.col("rank") <= n).select(*columns, "rank")
