"""Every registered query against its SQL in DuckDB, over the whole smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from proving.oracle import ORACLE
from proving.queries import QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(entry_points.oracle_sql()[name])
    types = {c[0]: str(c[1]) for c in result.description}
    rows = result.fetchall()
    assert sorted(types) == columns
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    place = [list(types).index(c) for c in columns]
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted((tuple(r[i] for i in place) for r in rows), key=key)
    assert got


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
