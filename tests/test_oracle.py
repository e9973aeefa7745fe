"""Every SQL-checkable query equals its independent DuckDB form on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as E
from airfill.registry import QUERIES
from oracle_queries import SQL as ORACLE
from airfill.sources.fixtures import BASE_TABLES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
# model fits are checked in test_model.py
SKIP = {"gbt_oof", "feature_importance", "q6_field_model", "model_mae_by_distance"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(k for k in ORACLE if k in QUERIES and k not in SKIP))
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF)
    a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    b, bc = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert ac == bc
    assert len(a) == len(b)
    assert a == b


def test_every_query_has_an_oracle_or_is_model():
    assert set(QUERIES) - set(ORACLE) == SKIP


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r["pollutant"] for r in rows} == {"no2", "pm25"}
    assert all(r["n"] > 0 for r in rows)
