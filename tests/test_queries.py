"""Every linkage query against its SQL on the smallest tables."""

import duckdb
import pytest

from tallyweave import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "pages", "part"):
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def _plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(queries.ORACLES[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(_plain(r[i]) for i in places) for r in found.fetchall()), key=repr)
