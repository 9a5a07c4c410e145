"""Bands: every value has one, and traps of off-by-one bounds."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegrid.functions import bands
from sitegrid.operators import grid
from sitegrid.sources.files import tile_name

BOUNDS = [(0, "a"), (3, "b"), (37, "c"), (38, "d")]


def test_every_ring_has_a_band(spark):
    df = spark.range(0, 45).select(F.col("id").cast("int").alias("k")).unionByName(spark.createDataFrame([(None,)], "k int"))
    got = {r["k"]: r["b"] for r in df.select("k", bands.threshold_band(F.col("k"), BOUNDS, "none", "none").alias("b")).collect()}
    assert [got[k] for k in (0, 1, 3, 4, 37, 38, 39, None)] == ["a", "b", "b", "c", "c", "d", "none", "none"]
    assert all(got[k] != "none" for k in range(39))


def test_closed_and_half_open_bounds(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (500.0,), (500.1,), (None,)], "x double")
    rows = df.select("x", bands.right_closed(F.col("x"), [0, 500, 1000], ["low", "high"]).alias("r"), bands.half_open(F.col("x"), [(0, 500, "low"), (500, 1000, "high")]).alias("h")).collect()
    assert [(r["r"], r["h"]) for r in rows] == [(None, None), (None, "low"), ("low", "high"), ("high", "high"), (None, None)]


def test_histogram_has_empty_bands(spark):
    df = spark.createDataFrame([("b",), ("b",), ("x",), (None,)], "band string")
    got = [(r["band"], r["n"], r["pct"]) for r in bands.band_histogram(df, "band", ["a", "b"]).orderBy("ord").collect()]
    assert got == [("a", 0, 0.0), ("b", 2, 100.0)]


def test_ordinal_of_unknown_is_null(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    assert [r[0] for r in df.select(bands.ordinal(F.col("x"), ["b", "a"])).collect()] == [2, None, None]


def test_tiles_on_both_sides_of_the_equator(spark):
    df = spark.createDataFrame([(-0.5, 117.2), (0.5, 117.2), (-1.0, -0.1)], "lat double, lon double")
    assert [r[0] for r in df.select(tile_name(F.col("lat"), F.col("lon"))).collect()] == ["S01E117", "N00E117", "S01W001"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**30), st.integers(0, 2**30)), min_size=1, max_size=20))
def test_cell_ids_round_trip(spark, cells):
    df = spark.createDataFrame(cells, "x long, y long").withColumn("c", grid.cell_id(F.col("x"), F.col("y")))
    x, y = grid.cell_xy(F.col("c"))
    px, py = grid.cell_xy(grid.parent(F.col("c")))
    for r in df.select("x", "y", x.alias("bx"), y.alias("by"), px.alias("px"), py.alias("py")).collect():
        assert (r["bx"], r["by"], r["px"], r["py"]) == (r["x"], r["y"], r["x"] >> 1, r["y"] >> 1)
