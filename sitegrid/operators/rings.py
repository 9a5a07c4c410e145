"""Rings of cells around points: nearest ring, coverage and catchments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.operators.grid import disk
from sitegrid.operators.skew import skew_join
from sitegrid.session import written

#: Rings per stage of a search: most points are near something and leave after a small disk.
STAGES = (2, 6, 15, 38)
#: Up to this many rings a disk is exploded; beyond, cells meet in blocks as wide as the disk's radius.
SMALL = 2


def _met(cells: DataFrame, targets: DataFrame, k: int, least: int = 0) -> DataFrame:
    """``x, y, k`` and the target's columns for every target ``tx, ty`` in rings ``least`` to ``k`` of the distinct cells.

    A small disk is exploded and joined cell by cell. A large one would have (2k + 1)**2 rows per cell, occupied or not:
    there each cell looks into its block of k by k cells and the eight around, and the distance decides. A block holds
    at most k * k distinct cells of either side, so none is hot.
    """
    if k <= SMALL:
        around = cells.select("x", "y", F.explode(disk(F.col("x"), F.col("y"), k, least)).alias("c")).select("x", "y", F.col("c.x").alias("tx"), F.col("c.y").alias("ty"), F.col("c.k").alias("k"))
        return around.join(targets, ["tx", "ty"])
    block = lambda c: F.floor(F.col(c) / k)
    near = F.array(*[F.struct((block("x") + dx).alias("bx"), (block("y") + dy).alias("by")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    looking = cells.select("x", "y", F.explode(near).alias("b")).select("x", "y", "b.bx", "b.by")
    there = targets.withColumns({"bx": block("tx"), "by": block("ty")})
    distance = F.greatest(F.abs(F.col("tx") - F.col("x")), F.abs(F.col("ty") - F.col("y"))).cast("int")
    return looking.join(there, ["bx", "by"]).withColumn("k", distance).where(F.col("k").between(least, k)).drop("bx", "by")


def nearest_ring(points: DataFrame, targets: DataFrame, cap: int = 38, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """``x, y, k[, ...]`` for each distinct cell of ``points(x, y)``: the least ring with a cell of ``targets(x, y, ...)``.

    Null k: nothing within ``cap`` rings, a finding. The search grows in stages; a stage looks only around cells that no
    earlier stage resolved. ``aggregates``: expressions over the target's columns and ``k`` in the least ring (such as
    the least label); they are taken per target cell first, so they must combine (min, max, bool_or).
    """
    extra = aggregates or {}
    cells = points.select("x", "y").distinct()
    there = targets.groupBy("x", "y").agg(*[a.alias(name) for name, a in extra.items()]) if extra else targets.select("x", "y").distinct()
    there = there.withColumnsRenamed({"x": "tx", "y": "ty"})
    stages = [s for s in STAGES if s < cap] + [cap]
    found, least, left = [], 0, cells
    for n, most in enumerate(stages):
        met = _met(left, there, most, least)
        if extra:
            hits = met.groupBy("x", "y").agg(F.min(F.struct("k", *extra)).alias("b")).select("x", "y", "b.*")
        else:
            hits = met.groupBy("x", "y").agg(F.min("k").alias("k"))
        last = n == len(stages) - 1
        hits = hits if last else written(hits, f"ring-{most}")
        found.append(hits)
        if not last:
            left = left.join(hits, ["x", "y"], "left_anti")
            if left.isEmpty():
                break
        least = most + 1
    return cells.join(reduce(DataFrame.unionByName, found), ["x", "y"], "left")


def with_ring(points: DataFrame, rings: DataFrame) -> DataFrame:
    """The points with their cell's result; a cell with a large part of the points is salted."""
    return skew_join(points, rings, ["x", "y"], "left")


def ring_minima(points: DataFrame, targets: DataFrame, cap: int, conditions: dict[str, Column]) -> DataFrame:
    """``x, y, k, <k_name>...``: the least ring over all targets and over those that meet each condition, from one scan.

    Conditions are taken per target cell first, so a cell meets one row per target cell.
    """
    cells = targets.groupBy(F.col("x").alias("tx"), F.col("y").alias("ty")).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"__{n}") for n, c in conditions.items()])
    own = points.select("x", "y").distinct()
    best = _met(own, cells, cap).groupBy("x", "y").agg(F.min("k").alias("k"), *[F.min(F.when(F.col(f"__{n}"), F.col("k"))).alias(n) for n in conditions])
    return own.join(best, ["x", "y"], "left")


def union_coverage(points: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """One row ``k, cells, covered``: cells within ``k`` rings of any point, each once, and the weight in them.

    ``weights(x, y, w)`` is summed per cell first.
    """
    cells = points.select("x", "y").distinct().select(F.explode(disk(F.col("x"), F.col("y"), k)).alias("c")).select("c.x", "c.y").distinct()
    inside = cells.join(weights.groupBy("x", "y").agg(F.sum("w").alias("w")), ["x", "y"], "left")
    return inside.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("w"), F.lit(0)).alias("covered"))


def catchments(points: DataFrame, weights: DataFrame, k: int, name: str = "catchment") -> DataFrame:
    """``x, y, <name>``: the weight within ``k`` rings of each distinct cell; catchments may overlap. 0 where nothing is."""
    own = points.select("x", "y").distinct()
    cells = weights.groupBy(F.col("x").alias("tx"), F.col("y").alias("ty")).agg(F.sum("w").alias("w"))
    sums = _met(own, cells, k).groupBy("x", "y").agg(F.sum("w").alias(name))
    return own.join(sums, ["x", "y"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
