"""Every registered query that has SQL gives the rows of that SQL; the others run."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, db, name):
    got = registered.queries()[name](spark, SMALL)
    want = db.sql(registered.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())


@pytest.mark.parametrize("name", ["q26_morse_graph"])
def test_query_without_sql_runs(spark, name):
    assert registered.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert registered.entry(spark).count() > 0
