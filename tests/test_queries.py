"""Every registered query with SQL gives what DuckDB gives on the smallest tables; the others run and have rows."""

import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from gneiss import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    cursor = con.execute(SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == names
    want = Counter(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
