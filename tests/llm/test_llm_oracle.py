"""The queries that SQL can express, against DuckDB."""

import pytest

import __spark_entry__ as E
from fedtab.llm.oracle import ORACLE
from fedtab.llm.queries import llm_queries
from fedtab.plans.compare import compare, duckdb_connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    ok, msg = compare(llm_queries()[name](spark, SF), duckdb_connection(SF), ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_every_numbered_operator_is_registered():
    names = E.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(ORACLE) <= set(E.oracle_sql()) <= set(names)
