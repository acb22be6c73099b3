"""Every registered query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from tardygrade import catalog
from tardygrade.catalog.queries import TABLES

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def _sorted(rows):
    return sorted((tuple(_cell(v) for v in row) for row in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {
        "bernoulli_sample", "bernoulli_fraction", "feature_vector", "lr_scores", "rf_scores", "gbt_scores",
        "score_test", "feature_importance", "model_roundtrip", "lr_v1_scores", "rf_v1_scores", "gbt_v1_scores",
    }
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})")
    assert sorted(want.columns) == columns
    assert _sorted(got.select(*columns).collect()) == _sorted(want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
