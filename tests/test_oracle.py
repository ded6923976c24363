"""Every registered query against its DuckDB oracle at sf0.001 (the driver uses sf0.01)."""

import pytest

import __spark_entry__ as E
from fedtab.plans.compare import compare, duckdb_connection
from fedtab.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF), con, SQL[name])
    assert ok, f"{name}: {msg}"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 15
    assert df.columns == ["method", "round", "bias", "n_layers_measured"]
