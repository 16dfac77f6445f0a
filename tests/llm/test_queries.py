"""Queries with SQL against it, and the driver's entry, on the smallest tables."""

import os

import duckdb
import pytest

from specweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{SF}/{file}')")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, tables, name):
    got, want = QUERIES[name](spark, SF), tables.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect())))
    assert rows == sorted(map(repr, (tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
