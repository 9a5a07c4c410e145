"""Points near points and in rings against all pairs, also at the poles and the antimeridian."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitegrid.functions.geo import geodesic_m
from sitegrid.operators import proximity
from sitegrid.operators.knn import nearest
from sitegrid.operators.polygons import simplified

POINTS, PLACES = "point_id long, lat double, lon double", "place_id long, lat double, lon double"


def metres(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def valid(p):
    return all(v is not None and v == v for v in p) and abs(p[0]) <= 90 and abs(p[1]) <= 180


def around(rng, lat, lon, n, spread):
    return [(max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), (lon + rng.uniform(-spread, spread) + 180) % 360 - 180) for _ in range(n)]


def test_radius_join_everywhere(spark):
    rng = random.Random(1)
    for lat, lon, radius in ((0, 0, 5_000), (0.001, 179.99, 5_000), (89.99, 10, 30_000), (-89.95, -170, 20_000), (60, -179.999, 8_000), (-6.2, 106.8, 400_000)):
        a = around(rng, lat, lon, 60, 0.1) + [(None, 1.0), (1.0, None), (float("nan"), 1.0), (91.0, 0.0), (0.0, 181.0)]
        b = around(rng, lat, lon, 60, 0.1) + [(None, None), (-95.0, 3.0)]
        found = proximity.near_points(spark.createDataFrame([(i, *p) for i, p in enumerate(a)], POINTS), spark.createDataFrame([(i, *p) for i, p in enumerate(b)], PLACES), radius)
        want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if valid(p) and valid(q) and metres(p, q) <= radius}
        assert {(r[0], r[1]) for r in found.collect()} == want, (lat, lon)


def inside(x, y, ring):
    out = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out = not out
    return out


def test_regions_of_any_size(spark):
    rng = random.Random(4)
    rings = []
    for size in (0.0005, 0.01, 0.5, 20.0, 100.0):
        cx, cy = rng.uniform(-60, 60), rng.uniform(-30, 30)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(8))
        ring = [(cx + size * rng.uniform(0.3, 1) * math.cos(t), max(-89.0, min(89.0, cy + size * rng.uniform(0.3, 1) * math.sin(t) * 0.5))) for t in angles]
        rings += [ring, [*ring, ring[0]]]
    points = [(y + rng.gauss(0, s / 3), x + rng.gauss(0, s / 2)) for ring, s in zip(rings, (0.0005, 0.0005, 0.01, 0.01, 0.5, 0.5, 20, 20, 100, 100), strict=True) for x, y in ring[:3] for _ in range(8)]
    as_ring = lambda ring: [{"x": x, "y": y} for x, y in ring]
    regions = [(i, as_ring(r)) for i, r in enumerate(rings)] + [(100, None), (101, []), (102, as_ring(rings[0][:2])), (103, [{"x": None, "y": 1.0}] * 4)]
    found = proximity.in_regions(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], POINTS), spark.createDataFrame(regions, "region_id long, ring array<struct<x: double, y: double>>"))
    want = {(i, j) for i, p in enumerate(points) for j, r in enumerate(rings) if valid(p) and inside(p[1], p[0], r)}
    assert {tuple(r) for r in found.collect()} == want and want


def test_nothing_to_find(spark):
    none, some = spark.createDataFrame([], POINTS), spark.createDataFrame([(1, 0.0, 0.0)], POINTS)
    places = spark.createDataFrame([(1, 0.0, 0.0)], PLACES)
    regions = spark.createDataFrame([], "region_id long, ring array<struct<x: double, y: double>>")
    assert proximity.near_points(none, places, 10.0).count() == 0
    assert proximity.near_points(some, places.limit(0), 10.0).count() == 0
    assert proximity.in_regions(some, regions).count() == 0


def test_a_place_shared_by_most_points(spark):
    points = spark.range(3000).select(F.col("id").alias("point_id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    places = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.001, 2.0), (3, 5.0, 5.0)], PLACES)
    assert proximity.near_points(points, places, 200.0).count() == 6000  # both places, 111 m apart
    here = points.withColumn("cell", proximity.point_cell(F.col("lat"), F.col("lon"), 1.0)).select("point_id", "cell.row", "cell.col")
    right = here.select("row", "col").distinct().withColumn("w", F.lit(1))
    assert proximity.skew_join(here, right, ["row", "col"], least_rows=100).count() == 3000


def test_nearest_is_exact(spark):
    rng = random.Random(8)
    a = [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(40)] + [(None, 1.0)]
    b = [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(15)]
    found = nearest(spark.createDataFrame([(i, *p) for i, p in enumerate(a)], POINTS), spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "target_id long, lat double, lon double"), first_m=200_000.0)
    want = {i: min((round(metres(p, q), 1), j) for j, q in enumerate(b))[1] for i, p in enumerate(a) if valid(p)}
    assert {r["point_id"]: r["target_id"] for r in found.collect()} == want


@pytest.mark.parametrize("self_join", [False, True])
def test_nearest_with_a_third_at_one_coordinate(spark, self_join):
    rng = random.Random(18)
    spots = [(rng.gauss(-2, 0.01), rng.gauss(110, 0.01)) for _ in range(40)] + [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(10)] + [(-2.0, 110.0)] * 30 + [(89.9, 10.0), (-89.99, 170.0)]
    rows = [(i, *p) for i, p in enumerate(spots)] + [(0, *spots[5])]
    points = spark.createDataFrame(rows, POINTS)
    targets = points.withColumnRenamed("point_id", "target_id").where(F.lit(self_join) | (F.col("target_id") % 3 == 0))
    got = {r["point_id"]: (r["target_id"], r["distance_m"]) for r in nearest(points, targets, self_join=self_join).collect()}
    want = {}
    for i, *p in rows:
        for j, *q in rows:
            if (i != j) if self_join else j % 3 == 0:
                want[i] = min(want.get(i, (math.inf, 0)), (round(metres(p, q), 1), j))
    assert {i: d for i, (_, d) in got.items()} == {i: d for i, (d, _) in want.items()}
    assert {i: j for i, (j, _) in got.items()} == {i: j for i, (_, j) in want.items()}


def test_geodesic_on_published_lines(spark):
    # lines of the WGS84 spheroid: a quarter of the equator, a meridian quadrant, and a short line
    rows = [(0.0, 0.0, 0.0, 90.0, 10018754.171), (0.0, 0.0, 90.0, 0.0, 10001965.729), (0.0, 0.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want double")
    for r in df.withColumn("m", geodesic_m("a", "b", "c", "d")).collect():
        assert (r["m"] is None and r["want"] is None) or abs(r["m"] - r["want"]) < 0.01


def test_simplified_rings_stay_close(spark):
    circle = [{"x": math.cos(t / 50 * math.pi), "y": math.sin(t / 50 * math.pi)} for t in range(100)]
    regions = spark.createDataFrame([(1, circle, "a"), (2, circle[:2], "b"), (3, None, "c"), (4, [], "d"), (5, [{"x": 0.0, "y": 0.0}] * 9, "e")], "region_id long, ring array<struct<x: double, y: double>>, extra string")
    out = {r["region_id"]: r for r in simplified(regions, 0.01).collect()}
    assert set(out) == {1} and out[1]["extra"] == "a"
    ring = [(p["x"], p["y"]) for p in out[1]["ring"]]
    assert 8 < len(ring) < 60 and ring[0] == ring[-1]
