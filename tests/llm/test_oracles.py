import duckdb
import pytest

from tallyweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in found.fetchall()), key=repr)
