"""Streams of several batches: repeats, late rows and what becomes of them."""

import datetime as dt

from sitegrid.streaming.registry import stream_table, with_late_rows

SCHEMA = "id long, at timestamp, v string"


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def test_late_rows_have_a_table_of_their_own(spark, tmp_path):
    folder = tmp_path / "t.parquet"
    batches = [[(1, day(0), "a"), (1, day(0), "a"), (2, day(30), "b")], [(1, day(1), "repeat"), (3, day(29), "c"), (4, day(5), "late")], [(5, None, "no time"), (3, day(31), "repeat"), (6, day(25), "d")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        # files are read in the order of their times
        import os
        import time

        for f in folder.glob("part-*"):
            if f.stat().st_mtime > 1_000_000 + len(batches):
                os.utime(f, (1_000_000 + i, 1_000_000 + i))
        time.sleep(0.01)
    rows, late = with_late_rows(stream_table(spark, str(tmp_path), "t", files_per_batch=1), ["id"], "at", "10 days")
    assert sorted(r["id"] for r in rows.collect()) == [1, 2, 3, 6]
    assert sorted(r["v"] for r in late.collect()) == ["late", "no time", "repeat"]


def test_a_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "t.parquet"))
    rows, late = with_late_rows(stream_table(spark, str(tmp_path), "t"), ["id"], "at")
    assert rows.count() == 0 and late.count() == 0
