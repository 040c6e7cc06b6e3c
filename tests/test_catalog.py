"""Every catalogue query against its SQL on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools_check import TABLES, compare, types_differ

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    assert types_differ(df, rel) == ""
    assert compare(df.toPandas(), rel.df()) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
