"""Every engine query against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from plexus.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in ORACLE:
        expected = tables.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(expected.columns)
        assert plain(rows, df.columns) == plain(expected.fetchall(), expected.columns)
    else:
        assert rows


def test_filters_reach_the_scan(spark, sf):
    text = QUERIES["dsl_one_hop"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,HOUSEHOLD)" in text and "GreaterThanOrEqual(o_totalprice,100000.0)" in text
    assert "l_orderkey" not in text


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
