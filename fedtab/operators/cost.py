"""Byte accounting (#29, #30, #42)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedtab.functions.params import MB, component, element_bytes, transmits
from fedtab.operators.state import param_max_shape


def _mb(cond: F.Column | None = None) -> F.Column:
    b = F.col("_bytes") if cond is None else F.when(cond, F.col("_bytes")).otherwise(F.lit(0))
    return F.sum(b) / F.lit(float(MB))


def communication_cost(meta: DataFrame, group_cols: Sequence[str] = ("client_id",)) -> DataFrame:
    """#29: MB in total and by A / B / head, and the number of values, per state."""
    m = meta.withColumn("_bytes", element_bytes("dtype", "n_rows", "n_cols")).withColumn("_c", component("param"))
    return m.groupBy(*group_cols).agg(
        _mb().alias("total_mb"),
        _mb(F.col("_c") == "lora_A").alias("lora_a_mb"),
        _mb(F.col("_c") == "lora_B").alias("lora_b_mb"),
        _mb(F.col("_c") == "head").alias("head_mb"),
        F.sum(F.col("n_rows").cast("long") * F.col("n_cols").cast("long")).alias("n_values"),
    )


def round_communication(meta: DataFrame, participants: DataFrame, methods: Sequence[str],
                        global_dtype: str = "float32") -> DataFrame:
    """#30: per (method, round): sum of client uploads + download size x successful clients.

    ``meta`` = (client_id, param, n_rows, n_cols, dtype); ``participants`` =
    (round, client_id) after cohort sampling and dropout; ``methods`` = method names.
    Uploads are the transmitted parameters of each participant; the download is
    the averaged state: every transmitted key at its max shape, in ``global_dtype``.
    A round without participants has no row.
    """
    sent = participants.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    sent = (meta.join(sent, "client_id")
            .filter(transmits("param", "method", "round")))
    up = communication_cost(sent, ["method", "round"]).select(
        "method", "round", F.col("total_mb").alias("upload_mb"))
    n = sent.groupBy("method", "round").agg(F.countDistinct("client_id").alias("n_clients"))
    shape = (param_max_shape(sent, ["method", "round"])
             .withColumn("dtype", F.lit(global_dtype)))
    down = communication_cost(shape, ["method", "round"]).select(
        "method", "round", F.col("total_mb").alias("download_mb"), "lora_a_mb", "lora_b_mb", "head_mb")
    out = up.join(n, ["method", "round"]).join(down, ["method", "round"])
    return out.select("method", "round", "n_clients", "upload_mb", "download_mb",
                      (F.col("upload_mb") + F.col("download_mb") * F.col("n_clients")).alias("round_mb"),
                      "lora_a_mb", "lora_b_mb", "head_mb")


def cumulative_communication(rounds: DataFrame, run_cols: Sequence[str] = ("method", "alpha"),
                             mb_col: str = "round_mb") -> DataFrame:
    """#42: running total of round MB within a run (one window partition per run:
    a run has one row per round)."""
    w = (Window.partitionBy(*run_cols).orderBy("round")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rounds.withColumn("cumulative_mb", F.sum(mb_col).over(w))
