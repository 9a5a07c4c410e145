"""Global order, name maps, aligned groups, tiles, layers, encrypted records, literals: nulls, ties, empty tables, errors."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sitegrid.functions import text as X
from sitegrid.functions.similarity import block_bound, block_similarity
from sitegrid.operators.order import aligned, numbered, resolved_names
from sitegrid.operators.tiles import Sampler, window_class, window_relief
from sitegrid.sources import files, geopackage, osm


def test_numbered_rows_of_many_parts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "b", "A", "a", "C"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "t string, place0 long").repartition(7)
    got = {r["place0"]: r["place"] for r in numbered(df, [F.desc_nulls_last("t"), F.asc("place0")]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, [-ord(c) for c in r[0] or ""], r[1]))
    assert got == {k: i for i, (_, k) in enumerate(order, 1)}
    assert numbered(df.limit(0), [F.asc("t")]).count() == 0


def test_name_maps_fail_on_anything_but_one_to_one(spark):
    name = F.lower(F.trim("n"))
    left = spark.createDataFrame([(1, "Aceh "), (2, "bali")], "id long, n string")
    right = spark.createDataFrame([("ACEH", 10), ("Bali", 20), ("Other", 30)], "n string, code long")
    assert {(r["id"], r["code"]) for r in resolved_names(left, right, name, name, ["code"]).collect()} == {(1, 10), (2, 20)}
    for bad_left, bad_right in ((left.union(spark.createDataFrame([(3, "Riau")], "id long, n string")), right), (left.union(spark.createDataFrame([(3, None)], "id long, n string")), right), (left.union(spark.createDataFrame([(3, "aceh")], "id long, n string")), right), (left, right.union(spark.createDataFrame([("aceh", 11)], "n string, code long")))):
        with pytest.raises(PySparkException):
            resolved_names(bad_left, bad_right, name, name, ["code"]).collect()
    assert resolved_names(left.limit(0), right, name, name, ["code"]).count() == 0


def test_aligned_groups_with_null_keys(spark):
    a, b = spark.createDataFrame([("x", 5), (None, 1)], "k string, n long"), spark.createDataFrame([("y", 2), (None, 4)], "k string, n long")
    got = {tuple(r) for r in aligned(a, b, ["k"], ["n"]).collect()}
    assert got == {("x", 5, 0, 5), ("y", 0, 2, -2), (None, 1, 4, -3)}


def test_points_of_tiles_fail_by_themselves(spark):
    sampler = Sampler(lambda lat, lon: F.floor(lat).cast("string"), lambda lat, lon: F.lit(1), lambda lat, lon: lon.cast("int"), 3, 1)
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.5, 0.0), (3, 7.5, 1.0), (4, None, 1.0), (5, 0.5, 9.0), (6, float("nan"), 1.0), (1, 0.5, 1.0)], "point_id long, lat double, lon double")
    tiles = spark.createDataFrame([("0", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]), ("1", None)], "tile string, cells array<double>")
    out = sampler.sample(points, tiles)
    got = {r["point_id"]: (r["value"], r["window"], r["error"]) for r in out.collect()}
    assert out.count() == 7
    assert got[1] == (5.0, [float(i) for i in range(1, 10)], None) and got[2] == (4.0, [1.0, 2.0, 4.0, 5.0, 7.0, 8.0], None)
    assert got[3] == (None, None, "no tile") and got[4][2] == got[6][2] == "no place" and got[5] == (None, None, "outside the tile")
    one = out.where("point_id = 2").select(window_class(F.col("window"), lambda v: F.when(v < 5, "low").otherwise("high")).alias("c"), window_relief(F.col("window")).alias("r")).collect()[0]
    assert tuple(one) == ("low", 7.0)  # three of each: the first seen
    assert sampler.sample(points.limit(0), tiles).count() == 0


def test_layers_with_and_without_geometries(spark, tmp_path):
    path = str(tmp_path / "a layer.gpkg")
    rows = [(i, None if i == 3 else f"n{i}", "polygon" if i % 2 else "point", [(float(i), 1.0), (2.0, 3.0), (4.0, 0.0), (float(i), 1.0)][: 4 if i % 2 else 1]) for i in range(25)] + [(99, "none", None, None)]
    geopackage.write_geopackage(spark.createDataFrame(rows, "id long, name string, kind string, ring array<struct<x: double, y: double>>"), path, "places")
    read = lambda **k: {r["id"]: r for r in geopackage.read_geopackage(spark, path, "places", {"id": "bigint", "name": "string"}, "geom", chunk=7, **k).collect()}
    got = read()
    assert len(got) == 26 and got[3]["name"] is None and got[99]["kind"] is None and got[99]["parts"] == []
    assert [tuple(p) for p in got[5]["parts"][0]] == [(5.0, 1.0), (2.0, 3.0), (4.0, 0.0), (5.0, 1.0)] and got[4]["kind"] == "point"
    assert len(read(skip=10, most=9)) == 9 and len(read(skip=100)) == 0
    assert set(read(box=(8.5, 0.5, 10.5, 1.5))) == {9, 10}
    plain = geopackage.read_geopackage(spark, path, "places", {"name": "string"}, chunk=7)
    assert plain.columns == ["name"] and plain.count() == 26


def test_damaged_payloads_are_rejects(spark):
    key = "k" * 32
    sent = spark.createDataFrame([(1,), (2,)], "id long").select(F.base64(F.aes_encrypt(F.to_json(F.struct("id")), F.lit(key), F.lit("CBC"), F.lit("PKCS"))).alias("p"))
    wrong = sent.select(F.base64(F.aes_encrypt(F.lit('{"id": 9}'), F.lit("x" * 32), F.lit("CBC"), F.lit("PKCS"))).alias("p")).limit(1)
    df = sent.union(wrong).union(spark.createDataFrame([("!!",), ("",), (None,)], "p string"))
    good, bad = files.decrypted(df, "p", key, "id bigint")
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and bad.count() == 4


def test_literals_and_sentences(spark):
    df = spark.createDataFrame([("a = 'x // y'; // 'no' \n b = \"q\\\"r\" /* \"no\n\" */ + `t\n${1}`",), ("",), (None,), ("// only",)], "s string")
    assert [r[0] for r in df.select(X.string_literals(F.col("s"))).collect()] == [["'x // y'", '"q\\"r"', "`t\n${1}`"], [], None, []]
    texts = spark.createDataFrame([("One. Two here! Three",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(X.sentence_at(F.col("t"), 6)).collect()] == ["Two here!", None, None]
    assert [r[0] for r in texts.select(X.sentence_at(F.col("t"), 60)).collect()] == [None, None, None]


def test_the_bound_holds_for_every_pair_of_names(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ABCDE 'é") for _ in range(rng.randrange(0, 9)))
    df = spark.createDataFrame([(word(), word()) for _ in range(300)], "a string, b string")
    assert df.where(block_similarity("a", "b") > block_bound(F.col("a"), F.col("b")) + 1e-9).count() == 0


def test_only_the_wanted_fields_of_a_struct_are_read(spark, folder, capfd):
    from sitegrid import plans

    plan = plans.queries()["nested_projection"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "bbox:struct<xmin:double,ymin:double>" in plan and "other" not in plan.split("ReadSchema")[-1] and "GreaterThan(bbox.ymin" in plan


def test_blocks_of_extracts_give_their_elements_again():
    rng = random.Random(5)
    rows = [{"kind": "node", "id": rng.randrange(1 << 40), "lat": rng.randrange(-900_000_000, 900_000_000) / 1e7, "lon": rng.randrange(-1_800_000_000, 1_800_000_000) / 1e7, "tags": [("name", f"é{i}")] * (i % 3 == 0), "refs": None} for i in range(50)]
    rows += [{"kind": "way", "id": 7 + i, "lat": None, "lon": None, "tags": [("highway", "track"), ("x", "")][: i % 3], "refs": [rng.randrange(1 << 35) for _ in range(i)]} for i in range(6)]
    got = list(osm.elements(osm.block_of(rows)))
    for a, b in zip(got, rows, strict=True):
        assert (a["kind"], a["id"], a["tags"], a["refs"]) == (b["kind"], b["id"], b["tags"], b["refs"])
        assert a["lat"] is None or abs(a["lat"] - b["lat"]) < 1e-9 and abs(a["lon"] - b["lon"]) < 1e-9


def test_ways_meet_their_nodes(spark, tmp_path):
    nodes = [("node", i, float(i), -float(i), {"k": "v"} if i == 2 else {}, None) for i in range(5)]
    ways = [("way", 10, None, None, {"building": "yes"}, [0, 1, 2, 0]), ("way", 11, None, None, {"highway": "track"}, [3, 4, 77]), ("way", 12, None, None, {}, [])]
    df = spark.createDataFrame(nodes + ways, osm.SCHEMA)
    path = str(tmp_path / "x.osm.pbf")
    osm.write_osm(df, path)
    read = osm.read_osm(spark, path)
    assert read.count() == 8 and read.where(F.col("tags")["k"] == "v").count() == 1
    got = {r["id"]: ([tuple(p) for p in r["ring"]], r["closed"]) for r in osm.lines(read, read.where("kind = 'way'")).collect()}
    assert got == {10: ([(0.0, 0.0), (-1.0, 1.0), (-2.0, 2.0), (0.0, 0.0)], True), 11: ([(-3.0, 3.0), (-4.0, 4.0)], False)}
    osm.write_osm(df.limit(0), path)
    assert osm.read_osm(spark, path).count() == 0


def test_a_layer_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "none.gpkg")
    geopackage.write_geopackage(spark.createDataFrame([], "id long, kind string, ring array<struct<x: double, y: double>>"), path, "places")
    assert geopackage.read_geopackage(spark, path, "places", {"id": "bigint"}, "geom").count() == 0
