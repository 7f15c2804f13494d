"""Every query with a SQL twin gives the same rows in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from conftest import SMALL
import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _sorted(found, names):
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    table = [tuple(_value(r[i]) for i in at) for r in found]
    return columns, sorted(table, key=lambda t: tuple((v is None, str(type(v)) if isinstance(v, (str, bool)) else "n", v if v is not None else 0) for v in t))


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    mine = _sorted([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    theirs = _sorted(cursor.fetchall(), [c[0] for c in cursor.description])
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert "psi" in entry.entry(spark).columns
