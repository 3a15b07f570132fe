"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from lexifacet import catalog


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        p = f"{SMALL}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    ran = con.execute(catalog.oracle_sql()[name])
    at = [x[0] for x in ran.description]
    assert sorted(at) == columns
    assert got == sorted(str(tuple(r[at.index(c)] for c in columns)) for r in ran.fetchall())
