"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from signalframe.plans.oracle import oracle_sql
from signalframe.plans.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    by_key = lambda r: ([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)])
    rows = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=by_key)
    expected = sorted((tuple(map(plain, r)) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()), key=by_key)
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-4)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
