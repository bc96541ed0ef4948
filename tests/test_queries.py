"""Every registered query against its DuckDB text on the smallest driver tables."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def canonical(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, DATA)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if key in ORACLE:
        cur = con.execute(ORACLE[key])
        assert got == canonical([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["api", "status"]
    assert set(ORACLE) <= set(QUERIES)
