"""A hierarchical square grid in integer micro-degrees: cells, parents, rings, disks and rasterised lines.

A cell of level L is ``BASE << L`` micro-degrees wide and high. Its id interleaves the bits of its column and row, so
ids sort by neighbourhood, the parent is the id without its last two bits, and all arithmetic is exact in integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Micro-degrees of the finest cells.
BASE = 50_000


def micro(degrees: Column) -> Column:
    """Degrees as whole micro-degrees, rounded down."""
    return F.floor(degrees * 1_000_000).cast("bigint")


def _spread(x: Column) -> Column:
    """The low 31 bits of x with a 0 between neighbours."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(x: Column) -> Column:
    """Every second bit of x, closed up."""
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def cell_id(ix: Column, iy: Column) -> Column:
    return _spread(ix.cast("bigint")).bitwiseOR(F.shiftleft(_spread(iy.cast("bigint")), 1))


def cell_xy(cell: Column) -> tuple[Column, Column]:
    return _gather(cell), _gather(F.shiftright(cell, 1))


def axes(lat_e6: Column, lon_e6: Column, level: int = 0, base: int = BASE) -> tuple[Column, Column]:
    """Column and row of the cell that holds a point."""
    size = base << level
    return F.floor((lon_e6 + 180_000_000) / size).cast("bigint"), F.floor((lat_e6 + 90_000_000) / size).cast("bigint")


def cell_of(lat_e6: Column, lon_e6: Column, level: int = 0, base: int = BASE) -> Column:
    return cell_id(*axes(lat_e6, lon_e6, level, base))


def parent(cell: Column, levels: int = 1) -> Column:
    return F.shiftright(cell, 2 * levels)


def children(cell: Column) -> Column:
    """The four cells of the level below, as an array."""
    return F.array(*[F.shiftleft(cell, 2) + i for i in range(4)])


def centre(cell: Column, level: int = 0, base: int = BASE) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre in micro-degrees."""
    ix, iy = cell_xy(cell)
    size = base << level
    return iy * size + size // 2 - 90_000_000, ix * size + size // 2 - 180_000_000


def corners(cell: Column, level: int = 0, base: int = BASE) -> Column:
    """The closed ring around a cell: array of (x longitude, y latitude) in degrees."""
    ix, iy = cell_xy(cell)
    size = base << level
    at = lambda dx, dy: F.struct(((ix + dx) * size - 180_000_000).cast("double").__truediv__(1e6).alias("x"), ((iy + dy) * size - 90_000_000).cast("double").__truediv__(1e6).alias("y"))
    return F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))


def hex_id(cell: Column) -> Column:
    """A cell id as 16 hexadecimal digits; text order is id order."""
    return F.lpad(F.lower(F.hex(cell)), 16, "0")


def disk(ix: Column, iy: Column, k: int, least: int = 0) -> Column:
    """Cells at Chebyshev distance ``least`` to ``k`` as an array of (x, y, k): (2k+1)**2 of them for least 0."""
    steps = [(dx, dy, max(abs(dx), abs(dy))) for dx in range(-k, k + 1) for dy in range(-k, k + 1) if max(abs(dx), abs(dy)) >= least]
    if len(steps) <= 64:
        return F.array(*[F.struct((ix + dx).alias("x"), (iy + dy).alias("y"), F.lit(d).alias("k")) for dx, dy, d in steps])
    across = F.sequence(F.lit(-k), F.lit(k))
    ring = lambda dx, dy: F.greatest(F.abs(dx), F.abs(dy))
    every = F.flatten(F.transform(across, lambda dx: F.transform(F.filter(across, lambda dy: ring(dx, dy) >= least), lambda dy: F.struct((ix + dx).alias("x"), (iy + dy).alias("y"), ring(dx, dy).alias("k")))))
    return every


def rasterised(lines: DataFrame, step_e6: int, level: int = 0, base: int = BASE) -> DataFrame:
    """``line_id, cell``: distinct cells that a straight line meets when sampled at most ``step_e6`` apart on either axis.

    ``lines(line_id, lat1, lon1, lat2, lon2)`` in micro-degrees. Samples are at whole micro-degrees (rounded down).
    """
    span = F.greatest(F.abs(F.col("lat2") - F.col("lat1")), F.abs(F.col("lon2") - F.col("lon1")))
    n = F.greatest(F.ceil(span / step_e6), F.lit(1)).cast("bigint")
    at = lambda a, b: F.col(a) + F.floor((F.col(b) - F.col(a)) * F.col("i") / F.col("n")).cast("bigint")
    sampled = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    return sampled.select("line_id", cell_of(at("lat1", "lat2"), at("lon1", "lon2"), level, base).alias("cell")).distinct()
