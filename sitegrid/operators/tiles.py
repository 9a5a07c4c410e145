"""Sampling of rasters kept in tiles: points meet their tile by name, a strategy says where they fall in it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.operators.skew import skew_join


@dataclass(frozen=True)
class Sampler:
    """How points are looked up: ``tile`` names the tile of a place, ``row`` and ``col`` say where the place is in it.

    ``tile``, ``row`` and ``col`` are functions of the columns of latitude and longitude; ``reach`` cells around the place
    are read (0: the place alone); tiles are ``width`` cells wide and row-major.
    """

    tile: Callable[[Column, Column], Column]
    row: Callable[[Column, Column], Column]
    col: Callable[[Column, Column], Column]
    width: int
    reach: int = 0

    def sample(self, points: DataFrame, tiles: DataFrame) -> DataFrame:
        """``point_id, tile, value, window, error`` of ``points(point_id, lat, lon)`` on ``tiles(tile, cells)``.

        ``value`` is the cell of the place, ``window`` the cells around it that there are, row by row. A point fails by
        itself, with an ``error`` and nulls: no place, no tile, or outside the tile. Points are grouped by tile through the
        join, so each tile is read once per task; a tile with a large part of the points is salted.
        """
        lat, lon = F.col("lat"), F.col("lon")
        known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
        placed = points.withColumns({"tile": F.when(known, self.tile(lat, lon)), "__row": F.when(known, self.row(lat, lon)), "__col": F.when(known, self.col(lat, lon))})
        met = skew_join(placed, tiles.select("tile", "cells"), ["tile"], "left")
        cell = lambda r, c: F.when((r >= 0) & (c >= 0) & (c < self.width), F.get("cells", (r * self.width + c).cast("int")))
        around = [(r, c) for r in range(-self.reach, self.reach + 1) for c in range(-self.reach, self.reach + 1)]
        window = F.filter(F.array(*[cell(F.col("__row") + r, F.col("__col") + c) for r, c in around]), lambda v: v.isNotNull())
        value = cell(F.col("__row"), F.col("__col"))
        error = F.when(~known, "no place").when(F.col("cells").isNull(), "no tile").when(value.isNull(), "outside the tile")
        out = met.withColumns({"value": value, "error": error})
        return out.select("point_id", "tile", "value", F.when(F.col("error").isNull(), window).alias("window"), "error")


def window_class(window: Column, classes: Callable[[Column], Column]) -> Column:
    """The most frequent class of a window, on a tie the one seen first; null for an empty window."""
    labels = F.transform(window, classes)
    counted = F.transform(F.array_distinct(labels), lambda k: F.struct((-F.size(F.filter(labels, lambda x: x == k))).alias("m"), F.array_position(labels, k).alias("first"), k.alias("class")))
    return F.array_min(counted)["class"]


def window_relief(window: Column) -> Column:
    """Greatest less least value of a window."""
    return F.array_max(window) - F.array_min(window)
