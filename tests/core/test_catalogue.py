"""Each query of the catalogue beside its SQL over the smallest tables."""

import os

import duckdb
import pytest

from loomwork.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def told(x):
    if isinstance(x, float):
        return repr(round(x, 7))
    if isinstance(x, (list, tuple)):
        return [told(v) for v in x]
    return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([told(r[c]) for c in columns]) for r in df.collect())
    q = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(q.columns) == columns
    order = [q.columns.index(c) for c in columns]
    assert got == sorted(str([told(r[i]) for i in order]) for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).limit(3).count() > 0
