"""A session for all tests, the test data's folder, and the comparison of a query with its SQL."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitegrid.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="4g", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(DATA):
        pytest.skip(f"no test data at {DATA}")
    return DATA


@pytest.fixture(scope="session")
def database(folder):
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return float(value) if value.__class__.__name__ == "Decimal" else value


@pytest.fixture(scope="session")
def same_as_sql(spark, folder, database):
    """A function that asserts that a query and its SQL give the same columns and rows."""

    def check(query, sql):
        df = query(spark, folder)
        cursor = database.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
        theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=str)
        assert ours == theirs

    return check
