"""Top N of groups against sorting, with ties, repeats, nulls and a group of most rows."""

import math
import random

from pyspark.sql import functions as F

from sitegrid.llm.topn import latest_of, top_n

SCHEMA = "g string, h long, id long, score double, volume double, rank string"
ORDER = [("score", "desc"), ("volume", "desc")]


def brute(rows, n):
    groups = {}
    for g, h, i, s, v, _ in rows:
        if s is not None and not math.isnan(s):
            groups.setdefault((g, h), []).append((-s, -v if v is not None else math.inf, i if i is not None else math.inf))
    return sorted(((g, h, None if i == math.inf else i, -s, k + 1) for (g, h), items in groups.items() for k, (s, _, i) in enumerate(sorted(items)[:n])), key=str)


def top(spark, rows, n, **options):
    df = spark.createDataFrame(rows, SCHEMA).drop("rank")
    got = top_n(df, ["g", "h"], n, ORDER, "id", **options)
    return sorted(((r["g"], r["h"], r["id"], r["score"], r["rank"]) for r in got.collect()), key=str)


def test_random_groups(spark):
    rng = random.Random(1)
    score = lambda: rng.choice([None, math.nan, -1.0, 0.0, *[float(rng.randrange(40)) for _ in range(6)], -math.inf])
    rows = [(rng.choice([None, "a", "b", "null", "c"]), rng.choice([None, 1, 2]), i, score(), rng.choice([None, 1.0, 2.0]), "x") for i in range(900)]
    for options in ({}, {"bands": 1}, {"bands": 9, "salts": 2}):
        assert top(spark, rows, 5, **options) == brute(rows, 5)


def test_one_group_of_most_rows_and_long_ties(spark):
    rows = [("hot", 1, i, 7.0, None, "x") for i in range(3000)] + [("cold", 1, 9000 + i, float(i), 1.0, "x") for i in range(3)]
    assert top(spark, rows, 4, salts=3) == brute(rows, 4)


def test_empty_and_unscored(spark):
    assert top(spark, [], 3) == []
    assert top(spark, [("a", 1, 1, None, 1.0, "x"), ("a", 1, 2, math.nan, 1.0, "x")], 3) == []


def test_repeated_rows_count_each(spark):
    rows = [("a", 1, 5, 2.0, 1.0, "x")] * 3 + [("a", 1, 6, 9.0, 1.0, "x")]
    assert [r[2] for r in sorted(top(spark, rows, 3), key=lambda r: r[4])] == [6, 5, 5]


def test_latest_row_of_a_key(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 3, None), (1, None, 9.0), (None, 9, 1.0)], "id long, at long, v double")
    assert [tuple(r) for r in latest_of(df, "id", "at", ["v"]).collect()] == [(1, None)]


def test_query_against_sql(same_as_sql):
    from sitegrid.llm import ORACLE, QUERIES

    for name in ORACLE:
        same_as_sql(QUERIES[name], ORACLE[name])


def test_lines_of_a_shuffled_copy(spark):
    rows = [("a", 1, i, float(i % 10), float(i % 3), "x") for i in range(500)]
    shuffled = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(3)).drop("rank")
    got = top_n(shuffled, ["g", "h"], 7, ORDER, "id").orderBy("rank")
    assert [r["id"] for r in got.collect()] == [r[2] for r in sorted(brute(rows, 7), key=lambda r: r[4])]
