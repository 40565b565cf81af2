"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest
from caseloom.operators import custom
from caseloom.plans import cases, library

FOLDER = "/root/testdata/sf0.001"
QUERIES = library.queries() | cases.queries() | custom.queries()
SQL = library.oracle_sql() | cases.oracle_sql() | custom.oracle_sql()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        path = f"{FOLDER}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = oracle.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr) == want


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
