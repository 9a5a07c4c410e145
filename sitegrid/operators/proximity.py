"""Points near other points or inside regions, by hashing to grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions.geo import METRES_PER_DEGREE, degree_window, haversine_m, in_ring, valid_point
from sitegrid.operators.skew import skew_join

#: Sides of the cells of nested levels are twice those of the level below; level LEVELS covers the globe.
LEVELS = 17


def _columns_in(row: Column, height: float) -> Column:
    """Cells of a row of the grid: as many as are ``height`` equatorial degrees wide at its edge nearer the pole, one at least."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(row * height), F.abs((row + 1) * height)))
    return F.greatest(F.lit(1), F.floor(360 / height * F.cos(F.radians(edge)))).cast("long")


def _row(lat: Column, height: float) -> Column:
    return F.floor(lat / height).cast("long")


def _column(lon: Column, row: Column, height: float) -> Column:
    cells = _columns_in(row, height)
    return F.pmod(F.floor((lon + 180) / 360 * cells).cast("long"), cells)


def point_cell(lat: Column, lon: Column, height: float) -> Column:
    """The one cell of a point: ``struct(row, column)``."""
    row = _row(lat, height)
    return F.struct(row.alias("row"), _column(lon, row, height).alias("col"))


def cells_of_box(south: Column, north: Column, west: Column, east: Column, height: float) -> Column:
    """All cells that a box meets, as an array; the box may cross the antimeridian (west below -180 or east above 180)."""
    rows = F.sequence(_row(F.greatest(south, F.lit(-90.0)), height), _row(F.least(north, F.lit(90.0)), height))

    def of_row(row: Column) -> Column:
        cells = _columns_in(row, height)
        first = F.floor((west + 180) / 360 * cells).cast("long")
        last = F.least(F.floor((east + 180) / 360 * cells).cast("long"), first + cells - 1)
        return F.transform(F.sequence(first, last), lambda c: F.struct(row.alias("row"), F.pmod(c, cells).alias("col")))

    return F.flatten(F.transform(rows, of_row))


def near_points(points: DataFrame, places: DataFrame, metres: float, salts: int = 32, few: bool = False) -> DataFrame:
    """Pairs ``point_id, place_id, distance_m`` within ``metres`` on the sphere.

    ``points(point_id, lat, lon)`` and ``places(place_id, lat, lon)``; cells are as high as the radius, so a place is
    copied to the three rows by three or so columns of cells around it and a point is in one cell; the great-circle
    distance decides. Null, NaN and impossible coordinates are near nothing; several rows of an id give several pairs.
    A cell with a large part of the points or of the places is salted; ``few`` says that there aren't enough rows for that.
    """
    height = metres / METRES_PER_DEGREE * 1.000001
    ok = valid_point(F.col("lat"), F.col("lon"))
    here = points.where(ok).withColumn("cell", point_cell(F.col("lat"), F.col("lon"), height)).select("point_id", "lat", "lon", "cell.row", "cell.col")
    dlat, dlon = degree_window(F.col("lat"), metres * 1.000001)
    around = places.where(ok).withColumns({"dlat": dlat, "dlon": dlon})
    box = cells_of_box(F.col("lat") - F.col("dlat"), F.col("lat") + F.col("dlat"), F.col("lon") - F.col("dlon"), F.col("lon") + F.col("dlon"), height)
    around = around.select("place_id", F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"), F.explode(box).alias("cell")).select("place_id", "place_lat", "place_lon", "cell.row", "cell.col")
    pairs = skew_join(here, around, ["row", "col"], "inner", salts, hot={} if few else None, both=not few)
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    return pairs.withColumn("distance_m", distance).where(F.col("distance_m") <= metres).select("point_id", "place_id", "distance_m")


def in_regions(points: DataFrame, regions: DataFrame, smallest_m: float = 400.0, salts: int = 32) -> DataFrame:
    """Pairs ``point_id, region_id`` of points inside rings: ``points(point_id, lat, lon)``, ``regions(region_id, ring)``.

    A region is hashed on the level of a nested grid whose cells are about as large as its box, so it meets a few cells
    whatever its size; a point is in one cell of each level that some region uses (at most 17). Points meet boxes first;
    rings join only the pairs whose point is in the box, and the even-odd rule decides. Rings need not be closed; a ring with a null, fewer than three points or none holds nothing. Regions are
    given in one piece, not across the antimeridian.
    """
    finest = smallest_m / METRES_PER_DEGREE
    coordinates = lambda c: F.transform(F.col("ring"), lambda p: p[c])
    boxed = regions.where((F.size("ring") > 2) & ~F.exists("ring", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())).withColumns({"west": F.array_min(coordinates("x")), "east": F.array_max(coordinates("x")), "south": F.array_min(coordinates("y")), "north": F.array_max(coordinates("y"))})
    boxed = boxed.where(valid_point(F.col("south"), F.col("west")) & valid_point(F.col("north"), F.col("east")))
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(finest))
    level = F.least(F.ceil(F.log2(extent / finest)), F.lit(LEVELS)).cast("int")
    cells = F.lit(None)
    for n in range(LEVELS, -1, -1):
        cells = F.when(F.col("level") == n, cells_of_box(F.col("south"), F.col("north"), F.col("west"), F.col("east"), finest * 2**n)).otherwise(cells)
    box = ["west", "east", "south", "north"]
    boxed = boxed.withColumn("__key", F.xxhash64("region_id", "ring"))
    hashed = boxed.withColumn("level", level).select("__key", *box, "level", F.explode(cells).alias("cell")).select("__key", *box, "level", "cell.row", "cell.col").distinct()
    used = [r["level"] for r in boxed.select(level.alias("level")).distinct().collect()]
    if not used:
        return points.sparkSession.createDataFrame([], f"point_id {dict(points.dtypes)['point_id']}, region_id {dict(regions.dtypes)['region_id']}")
    everywhere = F.array(*[F.struct(F.lit(n).alias("level"), point_cell(F.col("lat"), F.col("lon"), finest * 2**n).alias("cell")) for n in sorted(used)])
    here = points.where(valid_point(F.col("lat"), F.col("lon"))).select("point_id", "lat", "lon", F.explode(everywhere).alias("at")).select("point_id", "lat", "lon", "at.level", "at.cell.row", "at.cell.col")
    met = skew_join(here, hashed, ["level", "row", "col"], "inner", salts).where(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
    pairs = skew_join(met.select("point_id", "lat", "lon", "__key"), boxed.select("__key", "region_id", "ring"), ["__key"], "inner", salts)
    return pairs.where(in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).select("point_id", "region_id")
