"""Orphan references against sets."""

import random

from sitegrid.operators.references import Reference, orphan_counts, orphan_keys, orphan_rows


def references(spark, children, parents, others=()):
    c = spark.createDataFrame(children, "row_id long, key long, period string, listed boolean")
    p = spark.createDataFrame(parents, "key long, period string, table_name string")
    q = spark.createDataFrame(list(others), "row_id long, key long, period string, listed boolean")
    return [Reference("one", c, "row_id", "key", "period", "parents", p, "key", "period"), Reference("two", q, "row_id", "key", "period", "parents", p, "key", "period")]


def brute(name, children, parents):
    listed = {(k, d) for k, d, _ in parents if k is not None and d is not None}
    return {(name, d, r) for r, k, d, _ in children if k is not None and (k, d) not in listed}


def test_random_references(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.randrange(n), rng.choice([None, *range(12)]), rng.choice([None, "a", "b", ""]), None) for _ in range(n)]
    children, others = make(150), make(80)
    parents = [(rng.choice([None, *range(0, 12, 2)]), rng.choice([None, "a", "b"]), "x") for _ in range(40)]
    refs = references(spark, children, parents, others)
    found = {tuple(r) for r in orphan_rows(refs).collect()}
    # an empty period and a missing one are told apart by no reader; they are reported as missing
    want = {(t, d or None, r) for t, d, r in brute("one", children, parents) | brute("two", others, parents)}
    assert found == want
    counts = {(r["table_name"], r["period"]): r["orphan_rows"] for r in orphan_counts(refs).collect()}
    for (table, period), n in counts.items():
        rows = children if table == "one" else others
        listed = {(k, d) for k, d, _ in parents if k is not None and d is not None}
        assert n == sum(1 for _, k, d, _ in rows if k is not None and (k, d) not in listed and d == period)


def test_empty_tables(spark):
    assert orphan_rows(references(spark, [], [])).count() == 0
    assert orphan_keys(references(spark, [], [(1, "a", "x")])).count() == 0
    assert orphan_rows(references(spark, [(1, 5, "a", None), (1, 5, "a", None)], [])).count() == 1
    assert orphan_counts(references(spark, [(1, 5, "a", None)], [])).count() == 1


def test_parents_of_one_name_from_two_frames(spark):
    refs = references(spark, [(1, 10, "a", None), (2, 20, "a", None), (3, 30, "a", None)], [(10, "a", "x")])
    other = spark.createDataFrame([(20, "a")], "code long, day string")
    refs += [Reference("three", spark.createDataFrame([(9, 20, "a"), (8, 40, "a")], "row_id long, key long, period string"), "row_id", "key", "period", "parents", other, "code", "day")]
    assert {tuple(r) for r in orphan_rows(refs).collect()} == {("one", "a", 3), ("three", "a", 8)}
