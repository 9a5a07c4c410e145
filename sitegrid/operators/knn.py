"""Exact nearest neighbours: cells to rank, great-circle distances to decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.functions.geo import METRES_PER_DEGREE, degree_window, valid_point
from sitegrid.operators.proximity import cells_of_box, near_points, point_cell
from sitegrid.operators.skew import LEAST_ROWS, skew_join
from sitegrid.session import dropped, written

#: Heights of the search's cells, each GROWTH times the one before; the last ones hold the globe.
FINEST_M, GROWTH, HEIGHTS = 50.0, 4.0, 10
#: The search starts at the largest height of which no cell holds more distinct places than this.
MOST_IN_CELL = 16
#: A point whose cell is within a height of a place is no farther from it than this many heights.
REACH = 4.0
#: Queries (vectors) that are broadcast together.
QUERY_BLOCK = 4096
HALF_GLOBE_M = math.pi * 6_371_000.0


def first_height(places: DataFrame) -> int:
    """Number of the largest height of which no cell holds more than MOST_IN_CELL of the places (lat, lon); 0 if none."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), point_cell(F.col("lat"), F.col("lon"), height_of(i)).alias("cell")) for i in range(HEIGHTS)])
    counts = places.select(F.explode(cells).alias("c")).groupBy("c.i", "c.cell").agg(F.count(F.lit(1)).alias("n"))
    most = {r["i"]: r["m"] for r in counts.groupBy("i").agg(F.max("n").alias("m")).collect()}
    return max([i for i, m in most.items() if m <= MOST_IN_CELL], default=0)


def height_of(i: int) -> float:
    """Degrees of latitude of a cell."""
    return min(180.0, FINEST_M * GROWTH**i / METRES_PER_DEGREE)


def _places(targets: DataFrame, self_join: bool) -> DataFrame:
    """``lat, lon, target_id``: of all targets at one coordinate the one with the least id, and the next for a self join."""
    first = targets.groupBy("lat", "lon").agg(F.min("target_id").alias("target_id"))
    if not self_join:
        return first
    others = targets.join(first.withColumnRenamed("target_id", "__least"), ["lat", "lon"]).where(F.col("target_id") > F.col("__least"))
    return first.unionByName(others.groupBy("lat", "lon").agg(F.min("target_id").alias("target_id")))


def nearest(points: DataFrame, targets: DataFrame, within_m: float = HALF_GLOBE_M, first_m: float | None = None, self_join: bool = False, digits: int = 1) -> DataFrame:
    """``point_id, target_id, distance_m`` of the nearest target of each point (least id on a tie after rounding).

    ``points(point_id, lat, lon)``, ``targets(target_id, lat, lon)``; ``self_join`` leaves out targets with the point's
    own id. Points without coordinates or without a target within ``within_m`` have no row; of a point's several rows the
    nearest counts.

    Coordinates are searched, not rows: however many points share one, it is looked for once, and of the targets that
    share one only the least ids matter. The height of the cells suits the densest place (or is ``first_m``) and grows: at
    each height, only coordinates with a target in a cell about theirs are joined within the radius that is sure to
    hold it, so no pairs are made for the others and few for these; what is found is exact, since the radius holds every
    nearer target. Coordinates a third of the globe away from all targets meet all of them at the last height.
    """
    from_ = points.where(valid_point(F.col("lat"), F.col("lon"))).select("point_id", "lat", "lon")
    there = written(_places(targets.where(valid_point(F.col("lat"), F.col("lon"))).select("target_id", "lat", "lon").distinct(), self_join), "places")
    left = written(from_.select("lat", "lon").distinct(), "unresolved")
    copies = 9 * there.count()  # a place is in about so many cells
    start = first_height(there) if first_m is None else max(0, math.floor(math.log(first_m / FINEST_M, GROWTH)))
    found: list[DataFrame] = []
    for i in range(start, HEIGHTS):
        radius = min(REACH * height_of(i) * METRES_PER_DEGREE, within_m, HALF_GLOBE_M)
        last = radius >= min(within_m, HALF_GLOBE_M) or i == HEIGHTS - 1
        radius = min(within_m, HALF_GLOBE_M) if last else radius
        here = left.withColumn("point_id", F.struct("lat", "lon"))
        if not last:
            here = _beside(here, there, height_of(i))
        pairs = near_points(here, there.withColumnRenamed("target_id", "place_id"), radius, few=max(copies, left.count()) < LEAST_ROWS).select("point_id", F.col("place_id").alias("target_id"), F.round("distance_m", digits).alias("distance_m"))
        best = pairs.groupBy("point_id", "target_id").agg(F.min("distance_m").alias("distance_m"))
        rank = F.row_number().over(Window.partitionBy("point_id").orderBy("distance_m", "target_id"))
        best = best.withColumn("n", rank).where(F.col("n") <= (2 if self_join else 1)).select("point_id.lat", "point_id.lon", "n", "target_id", "distance_m")
        if not last:  # a target just beyond the radius may be as far after rounding
            best = best.where(F.col("distance_m") < radius - 10.0**-digits)
        best = written(best, "nearest")
        found.append(best)
        # of two candidates one isn't the point itself
        done = best.where(F.col("n") == (2 if self_join else 1)).select("lat", "lon")
        if last:
            break
        before, left = left, written(left.join(done, ["lat", "lon"], "left_anti"), "unresolved")
        dropped(before)
        if left.isEmpty():
            break
    candidates = skew_join(from_, reduce(DataFrame.unionByName, found).drop("n"), ["lat", "lon"])
    if self_join:
        candidates = candidates.where(F.col("point_id") != F.col("target_id"))
    return candidates.groupBy("point_id").agg(F.min(F.struct("distance_m", "target_id")).alias("b")).select("point_id", "b.target_id", "b.distance_m")


def _beside(here: DataFrame, places: DataFrame, height: float) -> DataFrame:
    """Points with a place within a cell's height of their cell: those of no such cell have no place within that height."""
    dlat, dlon = degree_window(F.col("lat"), height * METRES_PER_DEGREE)
    boxed = places.withColumns({"dlat": dlat, "dlon": dlon})
    cells = boxed.select(F.explode(cells_of_box(F.col("lat") - F.col("dlat"), F.col("lat") + F.col("dlat"), F.col("lon") - F.col("dlon"), F.col("lon") + F.col("dlon"), height)).alias("cell")).distinct()
    return here.withColumn("cell", point_cell(F.col("lat"), F.col("lon"), height)).join(cells, "cell", "left_semi").drop("cell")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """``vec_id, nearest_id, arc``: for each query the nearest vector of another id, as the angle between them (radians).

    Exact: a stated set of queries is searched against all unit vectors. Queries are read in blocks, each broadcast and
    passed over the vectors once; a batch is one product of matrices and only each query's best of it is shuffled.
    Null and empty vectors take no part; ties go to the least id.
    """
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    rows = queries.where(usable).select("vec_id", "embedding").distinct().orderBy("vec_id").toLocalIterator()
    context, out = vectors.sparkSession.sparkContext, None
    while held := list(islice(rows, block)):
        shared = context.broadcast((np.array([r["vec_id"] for r in held], np.int64), np.array([r["embedding"] for r in held], float)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for b in batches:
                own = b.column("vec_id").to_numpy()
                order = np.argsort(own, kind="stable")
                dots = np.round(matrix @ np.array(b.column("embedding").to_pylist(), float)[order].T, 9)
                dots[ids[:, None] == own[order][None, :]] = -2
                at = dots.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own[order][at]), pa.array(dots[np.arange(len(ids)), at])], names=["vec_id", "nearest_id", "dot"])

        found = vectors.where(usable).select("vec_id", "embedding").mapInArrow(best, "vec_id long, nearest_id long, dot double")
        out = found if out is None else out.union(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, nearest_id long, arc double")
    one = out.where("dot > -2").groupBy("vec_id").agg(F.min(F.struct((-F.col("dot")).alias("d"), "nearest_id")).alias("m"))
    dot = -F.col("m.d")
    return one.select("vec_id", "m.nearest_id", F.round(F.acos(F.when(dot > 1, 1.0).when(dot < -1, -1.0).otherwise(dot)), 4).alias("arc"))
