"""Report operators on the reference's published full-mode summary (golden figures)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedtab.operators import report
from fedtab.sources.results_io import read_results_csv

# The reference's published full-mode summary, in its CSV layout
# (a leading unnamed index column). Only the columns used here are kept.
FINAL_RESULTS_CSV = """,method,alpha,final_acc,total_comm_mb
0,standard_lora,10.0,0.8546052631578948,230.0
1,ffa_lora,10.0,0.8177631578947369,85.625
2,rolora,10.0,0.809078947368421,109.6875
3,standard_lora,0.5,0.6489473684210526,230.0
4,ffa_lora,0.5,0.536578947368421,85.625
5,rolora,0.5,0.5625,109.6875
6,standard_lora,0.1,0.3418421052631579,230.0
7,ffa_lora,0.1,0.3053947368421053,85.625
8,rolora,0.1,0.28039473684210525,109.6875
"""
SCHEMA = T.StructType([T.StructField("_idx", T.IntegerType()), T.StructField("method", T.StringType()),
                       T.StructField("alpha", T.DoubleType()), T.StructField("final_acc", T.DoubleType()),
                       T.StructField("total_comm_mb", T.DoubleType())])


@pytest.fixture(scope="module")
def final(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "final_results.csv"
    path.write_text(FINAL_RESULTS_CSV)
    return read_results_csv(spark, str(path), SCHEMA)


def _as_rounds(final):
    """One evaluated round per run carrying the run's final values."""
    return final.select("method", "alpha", F.lit(5).alias("round"), F.col("final_acc").alias("acc"),
                        F.col("final_acc").alias("f1"), F.lit(0.0).alias("loss"),
                        F.col("total_comm_mb").alias("comm_mb"), F.lit(0.0).alias("bias"))


def test_reader_drops_the_index_column(final):
    assert final.columns == ["method", "alpha", "final_acc", "total_comm_mb"]
    assert final.count() == 9


def test_accuracies_are_multiples_of_the_test_set(final):
    for r in final.collect():
        assert abs(r["final_acc"] * 7600 - round(r["final_acc"] * 7600)) < 1e-6


def test_comm_saving_golden(final):
    s = {(r["method"], r["alpha"]): r["saving_pct"] for r in report.comm_saving(_as_rounds(final)).collect()}
    assert round(s[("ffa_lora", 10.0)], 1) == 62.8
    assert round(s[("rolora", 10.0)], 1) == 52.3
    assert s[("standard_lora", 0.1)] == 0.0


def test_degradation_golden(final):
    rounds = _as_rounds(final)
    uploads = rounds.select("method", "alpha", "round", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("client_id"))
    d = {r["method"]: r["degradation_pts"] for r in report.degradation_report(rounds, uploads).collect()}
    assert round(d["standard_lora"], 2) == -51.28
    assert round(d["ffa_lora"], 2) == -51.24
    assert round(d["rolora"], 2) == -52.87


def test_accuracy_matrix_and_frontier(final):
    m = report.accuracy_matrix(final).collect()
    assert [r["alpha"] for r in m] == [10.0, 0.5, 0.1]
    assert m[0]["standard_lora"] == pytest.approx(0.8546052631578948)
    f = {(r["method"], r["alpha"]): r["on_frontier"] for r in report.efficiency_frontier(final).collect()}
    # cheapest run (ffa, alpha 10) and most accurate run (standard, alpha 10) are on the frontier
    assert f[("ffa_lora", 10.0)] and f[("standard_lora", 10.0)]
    assert not f[("rolora", 0.1)]
