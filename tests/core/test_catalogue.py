"""Every query of the engine's own catalogue against its SQL twin, row by row, at the smallest scale."""

import os

import duckdb
import pytest

from strataloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_every_query_has_a_twin():
    assert catalogue.QUERIES.keys() == catalogue.ORACLE.keys()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = sql.execute(catalogue.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    rows = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows
