"""Every query with SQL agrees with DuckDB on the smallest tables; every other one runs."""

import os

import pytest

from corvane.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        order, other = [df.columns.index(c) for c in sorted(df.columns)], [want.columns.index(c) for c in sorted(df.columns)]
        assert sorted(repr([plain(r[i]) for i in order]) for r in rows) == sorted(repr([plain(r[i]) for i in other]) for r in want.fetchall())
