"""Histories against a loop over the snapshots."""

import random

from sitegrid.operators.history import OPEN_END, attribute_history, snapshots_of

DAYS = ["2026-01-01", "2026-01-02", "2026-01-03"]
SNAPSHOTS = [(d, [f"a{i}", f"b{i}"]) for i, d in enumerate(DAYS)]
SCHEMA = "id long, at long, a0 double, b0 double, a1 double, b1 double, a2 double, b2 double, version string"


def brute(rows, tolerance):
    out = []
    for e in sorted({r[0] for r in rows if r[0] is not None}):
        last, versions = None, []
        for i, day in enumerate(DAYS):
            known = [(r[1] if r[1] is not None else float("-inf"), r[2 + 2 * i], r[3 + 2 * i]) for r in rows if r[0] == e and all(v is not None and v == v for v in r[2 + 2 * i : 4 + 2 * i])]
            if not known:
                continue
            _, a, b = max(known)
            if last is None or abs(a - last[0]) > tolerance or abs(b - last[1]) > tolerance:
                versions.append((day, a, b))
            last = (a, b)
        ends = [v[0] for v in versions[1:]] + [OPEN_END]
        out += [(e, n + 1, a, b, day, end) for n, ((day, a, b), end) in enumerate(zip(versions, ends, strict=True))]
    return out


def history(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in attribute_history(snapshots_of(df, "id", "at", SNAPSHOTS, ["a", "b"]), "id", "snapshot", ["a", "b"], 0.01).collect())


def test_random_histories(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([None, float("nan"), 1.0, 1.005, 1.02, 2.0])
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 1, 2, 3, 3]), *[value() for _ in range(6)]) for _ in range(60)]
    rows += rows[:5]
    assert history(spark, rows) == brute(rows, 0.01)


def test_empty_table_and_entities_without_values(spark):
    assert history(spark, []) == []
    assert history(spark, [(1, 1, None, 2.0, None, None, float("nan"), 1.0)]) == []


def test_exact_comparison_treats_null_as_a_value(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, None), (1, 4, "y")], "id long, s long, v string")
    got = [tuple(r) for r in attribute_history(df, "id", "s", ["v"]).orderBy("version").collect()]
    assert got == [(1, 1, "x", "1", "2"), (1, 2, None, "2", "4"), (1, 3, "y", "4", OPEN_END)]


def test_one_entity_with_most_rows(spark):
    rows = [(7, i, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0) for i in range(3000)] + [(8, 1, None, None, 5.0, 5.0, None, None)]
    assert history(spark, rows) == brute(rows, 0.01)
