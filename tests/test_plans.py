"""Plan properties of every registered query (the plan review, kept as tests).

A query that writes an intermediate table hides its work behind the final read, so
every plan is taken before its write, too.
"""

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as E
from fedtab.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)
#: Tables of one row per client, cell or parameter must not meet in one task.
DATA = r"client_id|param|example_id|\bi#|line_no|\btok\b"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Per query the plans of all tables that it writes and of its result."""
    seen = []
    real = {k: getattr(DataFrameWriter, k) for k in ("parquet", "csv", "text")}

    def noting(kind):
        def write(self, *a, **b):
            seen.append(plan_of(self._df))
            return real[kind](self, *a, **b)
        return write
    for k in real:
        setattr(DataFrameWriter, k, noting(k))
    try:
        out = {}
        for name in NAMES:
            seen.clear()
            df = E.queries()[name](spark, SF)
            out[name] = [*seen, plan_of(df)]
        return out
    finally:
        for k, v in real.items():
            setattr(DataFrameWriter, k, v)


@pytest.mark.parametrize("name", NAMES)
def test_no_pairwise_joins_or_row_udfs(plans, name):
    for plan in plans[name]:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDF
        assert not re.search("ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas(?!WithState)", plan)


@pytest.mark.parametrize("name", NAMES)
def test_nothing_large_meets_in_one_task(plans, name):
    """A single partition may hold totals and tables of one row per piece, not rows of data."""
    for plan in plans[name]:
        for window in re.findall(r"Window \[.*", plan):
            spec = re.search(r"windowspecdefinition\((.*)", window).group(1)
            if re.match(r"(?:_piece|[^,]* ASC|[^,]* DESC)", spec.strip()) and "_piece" not in spec:
                raise AssertionError(f"{name}: {window[:200]}")


def test_bias_is_one_aggregation_per_output_cell(plans):
    for name in ("aggregation_bias", "aggregation_bias_weighted"):
        for plan in plans[name]:
            assert "FullOuter" not in plan
        product = [p for p in plans[name] if re.search(r"hashpartitioning\([^)]*layer#\d+, i#\d+, j#\d+", p)]
        assert len(product) == 1 and len(re.findall(r"hashpartitioning\([^)]*layer#\d+, i#\d+, j#\d+", product[0])) == 1


def test_gram_form_has_no_cell_of_the_product(plans):
    for name in ("aggregation_bias_gram", "round_bias", "round_bias_carry_frozen"):
        for plan in plans[name]:
            assert not re.search(r"hashpartitioning\([^)]*\bi#\d+, j#\d+", plan)


def test_blocks_move_tiles(plans):
    """The average of blocked tensors is shuffled by (name, vector, tile) numbers."""
    assert any(re.search(r"hashpartitioning\(param_id#\d+, k#\d+, t#\d+", p) for p in plans["blocked_average"])


def test_models_are_never_gathered_in_one_row(plans):
    for plan in plans["round_report"]:
        assert not re.search(r"ObjectHashAggregate\(keys=\[\], functions=\[(?:partial_)?collect_list", plan)


def test_nothing_stays_persisted(spark, plans):
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0


@pytest.mark.parametrize("name", ["cohort_sample", "cap_per_group"])
def test_top_k_is_a_group_limit(plans, name):
    assert any(re.search(r"WindowGroupLimit .*Partial", p) for p in plans[name])


def test_round_state_read_prunes_partitions(plans):
    assert re.search(r"PartitionFilters: \[[^\]]*method[^\]]*round", plans["state_roundtrip"][-1])


def test_scan_reads_only_needed_columns(plans):
    scan = re.search(r"ReadSchema: struct<([^>]*)>", plans["scan_examples"][-1]).group(1)
    assert "source" not in scan and "n_chars" not in scan
