"""Registered text queries with SQL give the same rows in DuckDB."""

import duckdb
import pytest

from tardygrade.llm import catalog

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})")
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_text_query_is_there():
    assert [name.split("_")[0] for name in catalog.queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
