"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from gridterrain.catalogue import load

QUERIES, ORACLES = load()
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return con


def rows_of(table):
    columns = sorted(table.column_names)
    return columns, sorted(repr(tuple(row[c] for c in columns)) for row in table.to_pylist())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir).toArrow()
    theirs = duck.execute(ORACLES[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in ours.schema} == {f.name: str(f.type) for f in theirs.schema}
    assert rows_of(ours) == rows_of(theirs)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
