"""Defined results of the other core operators on nulls, ties, repeats, empty tables and clashing names."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrid.functions import text as X
from sitegrid.functions.similarity import block_similarity
from sitegrid.operators import clusters, drift, measures, profile, ranks, rasters, rings, search, stars, stats, verify
from sitegrid.operators.dedup import duplicate_audit, first_by, join_unique, latest_by
from sitegrid.operators.skew import hot_keys, skew_join
from sitegrid.sources import files, sinks


def test_first_and_latest(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 1, "c"), (None, 5, "x"), (None, 6, "y")], "k long, at long, v string")
    assert sorted((r["k"], r["v"]) for r in first_by(df, ["k"], ["at", "v"]).where("k = 1").collect()) == [(1, "c")]
    assert {(r["k"], r["v"]) for r in latest_by(df, ["k"], "at").collect()} == {(1, "b"), (None, "y")}
    assert duplicate_audit(df.limit(0), ["k"]).first()["n_rows"] == 0


def test_join_that_would_fan_out_fails(spark):
    left, good, bad = spark.range(3), spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    assert join_unique(left, good, ["id"]).count() == 3
    with pytest.raises(PySparkException):
        join_unique(left, bad, ["id"]).collect()


def test_salted_join_equals_plain_join(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    right = spark.createDataFrame([(7, "hot"), (7, "hot2"), (8, "x"), (99, "y"), (None, "n")], "k long, w string")
    assert hot_keys(left, ["k"], 100) == [(7,)]
    for how in ("inner", "left", "left_semi", "left_anti"):
        rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
        assert rows(skew_join(left, right, ["k"], how, salts=5, least_rows=100)) == rows(left.join(right, "k", how)), how
    many = right.unionByName(spark.range(600).select(F.lit(8).cast("long").alias("k"), F.col("id").cast("string").alias("w")))
    for a, b in ((left, many), (many, left)):
        assert rows(skew_join(a, b, ["k"], salts=5, least_rows=100, both=True)) == rows(a.join(b, "k"))
    with pytest.raises(ValueError):
        skew_join(left, right, ["k"], "full")


def test_exact_copies_under_a_hot_key_are_spread(spark):
    copies = spark.range(8000, numPartitions=16).select(F.lit(7).alias("k"), F.lit("same").alias("v"))
    joined = skew_join(copies, spark.createDataFrame([(7, "w")], "k int, w string").hint("merge"), ["k"], salts=8, least_rows=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together again
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 8000 and len(sizes) > 1


def test_shares_and_their_denominators(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("a", None), ("b", None)], "g string, km double")
    far = F.col("km") > 5
    got = {r["g"]: (r["s"], r["t"]) for r in df.groupBy("g").agg(measures.share(far).alias("s"), measures.share_of_all(F.col("km").isNull() | far).alias("t")).collect()}
    assert got == {"a": (50.0, 66.67), "b": (None, 100.0)}
    big = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "x long")
    assert int(big.agg(measures.exact_sum("x")).first()[0]) == 2**64 - 2
    three = spark.createDataFrame([(True, 1), (True, 0), (True, None), (False, None)], "l boolean, v int")
    assert [r[0] for r in three.select(measures.three_state(F.col("l"), F.col("v") > 0)).collect()] == [True, False, False, None]


def test_rollup_of_no_rows(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert measures.rollup_levels(df, {"a": ["a"], "a/b": ["a", "b"]}, [F.count(F.lit(1)).alias("n")]).count() == 0


def test_concentration_is_monotone_and_complete(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(60)] + [(99, None)], "id long, v double")
    got = [r["share"] for r in profile.concentration(df, "v", [1, 10, 100], ["id"]).orderBy("top_n").collect()]
    assert got == sorted(got) and got[-1] == 100.0
    assert profile.concentration(df.limit(0), "v", [1], ["id"]).first()["share"] is None


def test_mode_takes_the_least_on_a_tie(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), ("h", None)], "g string, v string")
    assert [tuple(r) for r in profile.modes(df, ["g"], "v").collect()] == [("g", "a", 1)]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(10)] + [("h", 3.0), ("h", None)], "g string, v double")
    assert {tuple(r) for r in profile.nearest_rank(df, ["g"], "v", 1.0).collect()} == {("g", 9.0), ("h", 3.0)}


def test_drift_of_missing_sides(spark):
    a, b = spark.createDataFrame([(1, 0), (2, 5), (3, None)], "k long, v long"), spark.createDataFrame([(2, 0), (3, 4), (4, 1)], "k long, v long")
    pairs = drift.side_by_side(a, b, "k", ["v"])
    assert {r["k"]: r["side"] for r in pairs.collect()} == {1: "only before", 2: "both", 3: "both", 4: "only after"}
    s = drift.drift_summary(pairs, ["v"]).first()
    assert (s["n_both"], s["n_changed"], s["n_to_zero"], s["n_from_zero"], s["net"]) == (2, 2, 1, 0, -1.0)


def test_override_and_name_path(spark):
    base = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "id long, lat double, source_id string")
    over = spark.createDataFrame([(1, 1, 9.0), (1, 2, None), (3, 1, 5.0)], "id long, at long, lat2 double")
    got = {r["id"]: (r["lat"], r["source"]) for r in stars.override_latest(base, over, "id", "at", {"lat": "lat2"}).collect()}
    assert got == {1: (1.0, "override"), 2: (2.0, "base")}
    left = spark.createDataFrame([(1, " a  b ", "X"), (2, None, "X"), (3, "zz", "X")], "i long, p string, d string")
    right = spark.createDataFrame([("A B", "x", 5), ("a b", "X", 4), (None, "x", 6)], "p string, d string, k long")
    assert {r["i"]: r["k"] for r in stars.name_path_join(left, right, ["p", "d"], ["k"], ["k"]).collect()} == {1: 4, 2: None, 3: None}


def test_cascade_stays_within_parents(spark):
    left = spark.createDataFrame([("P", "Sukamaju"), ("P", "sukamajuu"), ("Q", "Sukamaju"), ("P", None)], "p string, n string")
    right = spark.createDataFrame([("P", "SUKAMAJU", 1), ("P", "ELSE", 2)], "p string, n string, id long")
    got = [(r["p"], r["n"], r["matched_id"], r["match"]) for r in stars.cascade_match(left, right, "p", "n", "n", "id").collect()]
    assert sorted(got, key=str) == sorted([("P", "Sukamaju", 1, "exact"), ("P", "sukamajuu", 1, "similar"), ("Q", "Sukamaju", None, None), ("P", None, None, None)], key=str)


def test_rings_and_components(spark):
    points = spark.createDataFrame([(0, 0), (0, 0), (100, 100), (5000, 5000)], "x long, y long")
    targets = spark.createDataFrame([(1, 2), (100, 130)], "x long, y long")
    got = {(r["x"], r["y"]): r["k"] for r in rings.nearest_ring(points, targets, 38).collect()}
    assert got == {(0, 0): 2, (100, 100): 30, (5000, 5000): None}
    assert rings.nearest_ring(points, targets.limit(0), 10).where("k is null").count() == 3
    chain = spark.createDataFrame([(i, 0) for i in range(0, 60, 2)] + [(500, 500)], "x long, y long")
    labels = {r["component"] for r in clusters.components(chain, 2).collect()}
    assert len(labels) == 2
    assert clusters.components(chain.limit(0), 2).count() == 0
    assert clusters.colocation(chain.limit(0), ["x", "y"]).first()["entities"] == 0


def test_spearman_with_ties_and_p(spark):
    rows = [(float(i), float((i * 7) % 11 // 3)) for i in range(30)] + [(None, 1.0)]
    got = stats.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()

    def ranks(v):
        return [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]

    a, b = ranks([r[0] for r in rows[:30]]), ranks([r[1] for r in rows[:30]])
    ma, mb = sum(a) / 30, sum(b) / 30
    rho = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))
    assert abs(got["rho"] - rho) < 1e-6 and got["n"] == 30
    # Student's t: 0.05 two-sided at t = 2.0484 with 28 degrees of freedom
    t = 2.048407
    assert abs(stats.two_sided_p(t / math.sqrt(28 + t * t), 30) - 0.05) < 1e-5
    assert stats.spearman(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "x double, y double"), "x", "y").first()["rho"] is None


def test_weighted_draws_follow_the_weights(spark):
    items = spark.createDataFrame([(1, 1), (2, 0), (3, 9), (4, None)], "o long, w long")
    draws = spark.range(2000).select(F.lit(0).alias("draw"), F.col("id").alias("i"))
    n = {r["o"]: r["count"] for r in stats.weighted_draws(items, "o", "w", draws).groupBy("o").count().collect()}
    assert set(n) == {1, 3} and sum(n.values()) == 2000 and 120 < n[1] < 290
    assert stats.weighted_draws(items.limit(0), "o", "w", draws).count() == 0


def test_search_filters_and_pages(spark):
    df = spark.createDataFrame([("Banda Aceh", 1), ("Aceh", 5), ("Aceh Barat", 3), ("Rancaceh", 9), (None, 1)], "name string, n long")
    found = search.ranked_search(df, "name", "aceh", F.lit(1), "n")
    assert [r["name"] for r in found.collect()] == ["Aceh", "Aceh Barat", "Banda Aceh", "Rancaceh"]
    rows, at = search.page_of(df, [F.desc_nulls_last("n"), F.asc_nulls_last("name")], 99, 2, ("name", "ACEH ba"))
    assert at == 1 and [r["name"] for r in rows.collect()] == ["Aceh Barat", "Banda Aceh"]
    assert search.page_of(df.limit(0), [F.asc("n")], 3, 2)[1] == 1
    with pytest.raises(KeyError):
        search.filtered(df, {}, ["x"])


def test_numbers_links_and_sentences(spark):
    row = spark.createDataFrame([(44.65, 1234567.5, "a/b/c.html")], "x double, y double, base string")
    got = row.select(X.published_number(F.col("x"), 1, "%"), X.published_number(F.col("y")), *[X.resolved(F.col("base"), F.lit(u)) for u in ("../d.html?q#x", "#top", "./", "/z/", "../../../up.html", "")]).first()
    assert list(got) == ["44,7%", "1.234.568", "a/d.html", "a/b/c.html", "a/b/index.html", "z/index.html", "up.html", "a/b/c.html"]
    texts = spark.createDataFrame([("One. Two!  Three",), ("",), (None,), ("no mark",)], "t string")
    assert [r[0] for r in texts.select(X.sentences(F.col("t"))).collect()] == [["One.", "Two!", "Three"], [], None, ["no mark"]]
    assert X.sentence_with(F.col("t"), "!") is not None
    names = spark.createDataFrame([("Kab. Àcèh-Barat",), ("KOTA ACEH BARAT",), (None,)], "n string")
    assert [r[0] for r in names.select(X.admin_name(F.col("n"), ["kab", "kota"], {"barat": "brt"}, {"aceh brt": "ab"})).collect()] == ["ab", "ab", None]
    pairs = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(block_similarity("a", "b")).collect()] == [0.75, None, 1.0]


def test_checks_pass_fail_and_skip(spark):
    registry = verify.Registry()
    registry.check(3.0)(lambda s, d: s.range(3).agg(F.count(F.lit(1)).alias("three")))
    figure = registry.checks.popitem()[1]
    for published, status in ((3.0, "pass"), (3.5, "fail")):
        registry.checks["x"] = verify.Check("x", published, figure.compute)
        assert registry.run(spark, "").first()["status"] == status
    registry.checks["x"] = verify.Check("x", 1.0, lambda s, d: s.read.parquet("/nowhere/at/all"))
    assert registry.run(spark, "").first()["status"] == "skip"


def test_rasters_at_the_edge(spark):
    r = spark.createDataFrame([(1, [float(i) for i in range(9)]), (2, []), (3, None)], "id long, v array<double>")
    cells = rasters.window_values(r, "id", "v", 3, 0, 0, 1)
    assert sorted(x["v"] for x in cells.where("id = 1").collect()) == [0.0, 1.0, 3.0, 4.0]
    assert rasters.relief(cells, "id").first()["relief"] == 4.0 and cells.where("id > 1").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("v", T.DoubleType())])
    (tmp_path / "x.csv").write_text('id,name,v\n1,a,1.5\n2,b,c,2.5\n3,"d,e",3.5\n\n')
    good, damaged = files.read_csv_checked(spark, str(tmp_path / "x.csv"), schema, "id,name,v")
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, "a", 1.5), (3, "d,e", 3.5)]
    assert [r["line"] for r in damaged.collect()] == ["2,b,c,2.5"]
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    sinks.write_csv(df, str(tmp_path / "out"), {"from": "test"})
    assert '"from": "test"' in (tmp_path / "out" / "_source.json").read_text()
    assert files.schema_difference(df.schema, schema) == ["v is missing"]
    (tmp_path / "pages" / "skip").mkdir(parents=True)
    (tmp_path / "pages" / "a.html").write_text("<p>a</p>\n<p>b</p>")
    (tmp_path / "pages" / "skip" / "b.html").write_text("x")
    pages = files.read_pages(spark, str(tmp_path / "pages"), excluded=["/skip/"]).collect()
    assert len(pages) == 1 and "<p>b</p>" in pages[0]["text"]
    (tmp_path / "f.json").write_text('{"type": "FeatureCollection",\n "features": [{"properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}')
    f = files.read_features(spark, str(tmp_path / "f.json"), T.StructType([T.StructField("id", T.LongType())])).first()
    assert (f["id"], f["geometry_type"], f["coordinates"]) == (1, "Point", [1.0, 2.0])


def test_registry_is_idempotent(spark):
    registry = spark.createDataFrame([(1,)], "id long")
    incoming = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (None, "c")], "id long, v string")
    fresh = sinks.append_new(registry, incoming, "id")
    assert [tuple(r) for r in fresh.collect()] == [(2, "a")]
    assert sinks.append_new(registry.union(fresh.select("id")), incoming, "id").count() == 0
    ok, bad = sinks.split_rejects(incoming, {"id": F.col("id").isNotNull(), "v": F.col("v") != "a"})
    assert ok.count() == 1 and sorted(r["_reason"] for r in bad.collect()) == ["id", "v", "v"]


def test_index_filter_reaches_the_scan(spark, tmp_path):
    cells = spark.range(1000).select((F.col("id") * 16).alias("cell"))
    sinks.write_index(cells, str(tmp_path / "index"), "cell", F.shiftright("cell", 8), 4)
    plan = spark.read.parquet(str(tmp_path / "index")).where(F.col("p").isin(3, 4))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(p, [3,4])]" in plan


def test_unsettled_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="settled"):
        clusters.components(spark.createDataFrame([(x, 0) for x in range(9)], "x long, y long"))


def test_quantiles_of_groups_measures_and_ties(spark):
    rng = random.Random(21)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([0.0, 0.0, float("nan"), None, rng.gauss(0, 5)]), rng.randrange(1000)) for _ in range(3000)] + [("c", 7.0, 1), ("d", None, 2)]
    df = spark.createDataFrame(rows, "g string, x double, y long")
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["g"], r["measure"], r["q"]): (r["value"], r["n"]) for r in ranks.quantiles(df, ["g"], {"x": F.col("x"), "y": F.when(F.col("x") > 0, F.col("y"))}, qs).collect()}
    for g in ("a", "b", None, "c", "d"):
        for m, values in (("x", [x for k, x, _ in rows if k == g and x is not None and x == x]), ("y", [float(y) for k, x, y in rows if k == g and x is not None and (x != x or x > 0)])):  # NaN is above all
            for q in qs:
                if values:
                    assert got[g, m, q][1] == len(values) and abs(got[g, m, q][0] - np.quantile(values, q)) < 1e-9
                else:
                    assert (g, m, q) not in got
    near = {r["g"]: r["value"] for r in ranks.quantiles(df, ["g"], {"x": F.col("x")}, [0.9], nearest=True).collect()}
    values = sorted(x for k, x, _ in rows if k == "a" and x is not None and x == x)
    assert near["a"] == values[min(len(values) - 1, int(len(values) * 0.9))]
    assert ranks.quantiles(df.limit(0), ["g"], {"x": F.col("x")}, qs).count() == 0
    whole = ranks.with_quantiles(df.agg(F.count(F.lit(1)).alias("n")), df, [], {"m": (F.col("y"), 0.5)}).collect()[0]
    assert whole["n"] == len(rows) and whole["m"] == np.median([y for _, _, y in rows])
