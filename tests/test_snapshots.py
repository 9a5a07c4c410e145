"""Snapshot differences against dictionaries."""

import datetime as dt
import random

from sitegrid.operators.snapshots import snapshot_changes, with_values

DAYS = ["2026-01-01", "2026-01-02", "2026-01-03"]
SCHEMA = "id long, day date, loaded long, v long, t0 string"


def brute(rows):
    latest = {}
    for key, day, loaded, v, _ in rows:
        if key is None or day is None:
            continue
        rank = (loaded if loaded is not None else float("-inf"), v if v is not None else float("-inf"))
        if (key, day) not in latest or rank > latest[key, day][0]:
            latest[key, day] = (rank, v)
    out = []
    for a, b in zip(DAYS, DAYS[1:], strict=False):
        da, db = dt.date.fromisoformat(a), dt.date.fromisoformat(b)
        for key in {k for k, _ in latest}:
            x, y = latest.get((key, da)), latest.get((key, db))
            if x and not y:
                out.append((key, a, b, "removed", x[1], None))
            elif y and not x:
                out.append((key, a, b, "added", None, y[1]))
            elif x and y and x[1] != y[1]:
                out.append((key, a, b, "changed", x[1], y[1]))
    return sorted(out, key=str)


def changes(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    found = snapshot_changes(df, "id", "day", "loaded", ["v"], DAYS, **options)
    full = with_values(found, df, "id", "day", "loaded", ["v"])
    assert found.count() == full.count()
    return sorted((tuple(r) for r in full.collect()), key=str)


def test_random_snapshots(spark):
    rng = random.Random(5)
    day = lambda: rng.choice([*[dt.date.fromisoformat(d) for d in DAYS], None, dt.date(2025, 1, 1)])
    rows = [(rng.choice([None, *range(-20, 60)]), day(), rng.choice([None, 1, 2, 2]), rng.choice([None, 0, 5, 7]), "x") for _ in range(400)]
    rows += rows[:30]
    assert changes(spark, rows) == brute(rows)
    assert changes(spark, rows, bucket_rows=5) == brute(rows)


def test_null_is_a_value_and_empty_tables(spark):
    d = [dt.date.fromisoformat(x) for x in DAYS]
    rows = [(1, d[0], 1, None, "x"), (1, d[1], 1, 0, "x"), (1, d[2], 1, None, "x"), (2, d[0], 1, None, "x"), (2, d[1], 9, None, "x"), (2, d[2], 1, None, "x")]
    assert [r[3] for r in changes(spark, rows)] == ["changed", "changed"]
    assert changes(spark, []) == []


def test_one_key_with_most_rows(spark):
    d = [dt.date.fromisoformat(x) for x in DAYS]
    rows = [(7, d[i % 2], i, i, "x") for i in range(4000)] + [(8, d[0], 1, 1, "x")]
    assert changes(spark, rows) == brute(rows)


def test_several_tracked_columns_are_hashed_first(spark):
    d = [dt.date.fromisoformat(x) for x in DAYS]
    rows = [(1, d[0], 1, 5, "a"), (1, d[1], 1, 5, "b"), (1, d[2], 1, None, "b"), (2, d[0], 1, 5, None), (2, d[0], 1, 6, None), (2, d[1], 2, 5, None), (2, d[1], 1, 9, "z"), (2, d[2], 2, 5, None)]
    df = spark.createDataFrame(rows, "id long, day date, loaded long, v long, w string")
    found = snapshot_changes(df, "id", "day", "loaded", ["v", "w"], DAYS)
    full = sorted((tuple(r) for r in with_values(found, df, "id", "day", "loaded", ["v", "w"]).collect()), key=str)
    one = [r for r in full if r[0] == 1]
    assert one == [(1, *DAYS[:2], "changed", 5, 5, "a", "b"), (1, *DAYS[1:], "changed", 5, None, "b", "b")]
    # of the tie of key 2 the same row counts in the comparison and in the values
    assert all(r[4:] != (5, 5, None, None) for r in full) and {r[4] for r in full if r[0] == 2} <= {6}
