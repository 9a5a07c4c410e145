"""Every registered query of the core runs; those with SQL give the same rows as DuckDB."""

import pytest
from pyspark.sql import functions as F

from sitegrid import plans
from sitegrid.functions.text import distance_label
from sitegrid.operators.stats import places_nulls_last

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, folder):
    assert QUERIES[name](spark, folder).count() > 0


def test_names_are_unique_and_known():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 120


def test_every_order_is_rendered(spark, folder, database):
    assert QUERIES["number_rendering_all"](spark, folder).count() == database.execute("select count(*) from orders").fetchone()[0]


@pytest.mark.parametrize(("name", "driving"), [("recode_and_fill_all", "customer"), ("guarded_left_join", "lineitem")])
def test_as_many_rows_as_the_driving_table(name, driving, spark, folder, database):
    assert QUERIES[name](spark, folder).count() == database.execute(f"select count(*) from {driving}").fetchone()[0]


def test_every_supplier_is_placed_in_both_directions(spark, folder, database):
    rows = QUERIES["nulls_last_places"](spark, folder).collect()
    keys = [r[0] for r in database.execute("select s_suppkey from supplier").fetchall()]
    unknown = {k for k in keys if k % 9 == 0}
    assert len(rows) == 2 * len(keys) and unknown
    for direction in ("up", "down"):
        assert {r["s_suppkey"] for r in rows if r["direction"] == direction and r["place"] > len(keys) - len(unknown)} == unknown


def test_places_of_ties_and_nulls(spark):
    rows = [(k, [None, 5.0, 5.0, -1.0, 2.0][k % 5]) for k in range(1, 400)] + [(400 + k, float(k)) for k in range(100)]
    got = {r["k"]: (r["up"], r["down"]) for r in places_nulls_last(spark.createDataFrame(rows, "k long, v double"), "v", "k").collect()}
    order = lambda sign: {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0])), 1)}
    up, down = order(1), order(-1)
    assert got == {k: (up[k], down[k]) for k, _ in rows}
    nothing = spark.createDataFrame([(1, None), (2, None)], "k long, v double")
    assert sorted(tuple(r) for r in places_nulls_last(nothing, "v", "k").select("k", "up", "down").collect()) == [(1, 1, 1), (2, 2, 2)]


def test_labels_round_the_exact_value(spark):
    df = spark.createDataFrame([(289450.0,), (496250.0,), (384750.0,), (1050.0,), (1999.99,), (999.4,), (None,)], "x double")
    assert [r[0] for r in df.select(distance_label(F.col("x"))).collect()] == ["289.4 km", "496.2 km", "384.8 km", "1.1 km", "2.0 km", "999 m", "> 5 km"]
