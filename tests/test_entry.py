"""The driver's contract."""

import __spark_entry__ as entry


def test_queries_and_sql_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p3_found", "p4_found", "p6_found"} <= set(entry.queries())


def test_flagship_has_rows(spark, folder):
    df = entry.entry(spark)
    assert df.count() > 0 and "r_name" in df.columns
