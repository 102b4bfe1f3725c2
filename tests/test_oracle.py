"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from carillon.plans import registry

SQL = registry.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, db, name):
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    res = db.execute(SQL[name])
    types = {d[0]: str(d[1]) for d in res.description}
    rows = res.fetchall()
    assert sorted(types) == cols
    at = [list(types).index(c) for c in cols]
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    assert got == sorted(tuple(_plain(r[k]) for k in at) for r in rows)


def test_names_are_unique_and_flagship_is_there():
    assert registry.FLAGSHIP in registry.queries() and set(SQL) <= set(registry.queries())
