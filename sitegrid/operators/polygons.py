"""Polygons: points inside, depth to the edge, quality and simplification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions.geo import METRES_PER_DEGREE, ring_area_m2
from sitegrid.operators.proximity import in_regions


def edge_distance_m(lat: Column, lon: Column, ring: Column) -> Column:
    """Metres from a point to the nearest edge of a ring, in a plane around the point (for rings of a few km)."""
    scale = F.cos(F.radians(lat))
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))

    def one(a: Column, b: Column) -> Column:
        ax, ay, bx, by = (a["x"] - lon) * scale, a["y"] - lat, (b["x"] - lon) * scale, b["y"] - lat
        dx, dy = bx - ax, by - ay
        t = F.coalesce(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.sqrt(F.pow(ax + t * dx, F.lit(2)) + F.pow(ay + t * dy, F.lit(2))) * METRES_PER_DEGREE

    return F.array_min(F.zip_with(ring, after, one))


def depths(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``point_id, region_id, depth_m`` of points inside regions: ``points(point_id, lat, lon)``, ``regions(region_id, ring)``."""
    inside = in_regions(points, regions)
    return inside.join(points.select("point_id", "lat", "lon"), "point_id").join(regions, "region_id").select("point_id", "region_id", F.round(edge_distance_m(F.col("lat"), F.col("lon"), F.col("ring")), 1).alias("depth_m"))


def quality(regions: DataFrame, points: DataFrame) -> DataFrame:
    """``region_id, n_points, area_m2, n_inside``: size of each ring on the sphere and points within (0 included)."""
    counts = in_regions(points, regions).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_inside"))
    sized = regions.select("region_id", F.size("ring").alias("n_points"), F.round(ring_area_m2(F.col("ring")), 0).alias("area_m2"))
    return sized.join(counts, "region_id", "left").withColumn("n_inside", F.coalesce("n_inside", F.lit(0)))


def _kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points the Douglas-Peucker rule (1973) keeps of an open line, with a stack in place of recursion."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = np.hypot(dx, dy)
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        away = np.hypot(px, py) if length == 0 else np.abs(dx * py - dy * px) / length
        at = int(away.argmax())
        if away[at] > tolerance:
            keep[a + 1 + at] = True
            stack += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def simplified(regions: DataFrame, tolerance: float, least_points: int = 4, digits: int = 5) -> DataFrame:
    """Closed rings with fewer points: none dropped lies farther than ``tolerance`` (degrees) from the new line.

    Coordinates are rounded; rings that would have fewer than ``least_points`` points (the closing one included) are
    small parts and are dropped. Null and empty rings are dropped. Extra columns are kept.
    """
    schema = regions.schema

    def simple(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings, rows = [], []
            for i, ring in enumerate(b.column("ring").to_pylist()):
                points = [(p["x"], p["y"]) for p in ring or [] if p and p["x"] is not None and p["y"] is not None]
                if len(points) < 3:
                    continue
                points = points if points[0] == points[-1] else [*points, points[0]]
                x, y = (np.array(v, float) for v in zip(*points, strict=True))
                # a closed line is cut at its farthest point, or all would be measured from one spot
                half = int(np.hypot(x - x[0], y - y[0]).argmax())
                keep = np.concatenate([_kept(x[: half + 1], y[: half + 1], tolerance)[:-1], _kept(x[half:], y[half:], tolerance)])
                if keep.sum() >= least_points:
                    rings.append([{"x": round(float(a), digits), "y": round(float(c), digits)} for a, c in zip(x[keep], y[keep], strict=True)])
                    rows.append(i)
            out = b.take(pa.array(rows, pa.int64()))
            columns = [pa.array(rings, b.schema.field("ring").type) if n == "ring" else out.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return regions.mapInArrow(simple, schema)
