"""Parameter-state tables (#19, #20, #23-#25).

A state is a long table of cells ``(…, client_id, param, i, j, v)``; a missing
cell means 0. That single convention gives the reference's zero-padding for
free: a rank-4 factor simply has no cells in rows/columns 4..7.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_KEYS = ("param", "i", "j")


def group_weight(meta: DataFrame, n_col: str = "n_samples", partition_cols: Sequence[str] = ()) -> DataFrame:
    """#23: w_k = n_k / sum(n) over the participating clients of the same round.

    The total is an aggregate that joins back, so no task holds all clients.
    """
    out = with_total(meta, F.sum(n_col), "_total", partition_cols)
    return out.withColumn("weight", F.col(n_col).cast("double") / F.col("_total")).drop("_total")


def with_total(df: DataFrame, total: Column, name: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Add an aggregate over each group (over all rows without groups) to every row.

    Without groups the aggregate is a scalar subquery: no join and no broadcast.
    """
    g = list(group_cols)
    if g:
        return df.join(df.groupBy(*g).agg(total.alias(name)), on=g, how="inner")
    return df.withColumn(name, df.agg(total.alias(name)).scalar())


def weighted_padded_average(cells: DataFrame, weights: DataFrame, group_cols: Sequence[str] = (),
                            client_col: str = "client_id") -> DataFrame:
    """#24: sum_k w_k * theta_k per cell, lower-rank tensors zero-padded.

    ``weights`` holds (group..., client, weight) with weights normalised over all
    participants, so a client lacking a key or a cell still counts in the total
    (never ``avg``). The per-client weight row joins by key; the aggregation
    shuffles once on (group, param, i, j) after a map-side partial sum.
    """
    g = list(group_cols)
    # one weight row per (round, client): AQE broadcasts it by its bytes, or splits a hot client
    w = weights.select(*g, client_col, "weight")
    joined = cells.join(w, on=[*g, client_col], how="inner")
    return (joined.groupBy(*g, *CELL_KEYS)
            .agg(F.sum(F.col("weight") * F.col("v")).alias("v")))


def param_max_shape(meta: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """#25: union of keys over clients and the element-wise max shape per key."""
    return (meta.groupBy(*group_cols, "param")
            .agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"),
                 F.count(F.lit(1)).alias("n_clients")))


def state_overlay(local: DataFrame, global_: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """#19: copy global values into local states by name and position.

    The local side fixes the shape: cells beyond it in the global vanish,
    local cells the global lacks keep their value (trap T6), names unknown to
    the global are left alone.
    """
    g = list(group_cols)
    gl = global_.select(*g, *CELL_KEYS, F.col("v").alias("_gv"))
    out = local.join(gl, on=[*g, *CELL_KEYS], how="left")
    return out.withColumn("v", F.coalesce(F.col("_gv"), F.col("v"))).drop("_gv")


def key_presence_filter(cells: DataFrame, other: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """#20: keep parameters whose name exists on the other side (left-semi join)."""
    # distinct parameter names: AQE broadcasts them by their bytes, or splits a hot parameter
    keys = other.select(*group_cols, "param").distinct()
    return cells.join(keys, on=[*group_cols, "param"], how="left_semi")


def upsert_state(previous: DataFrame, update: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """State as an upsert (trap T3): transmitted parameters replace their cells,
    untransmitted ones keep their last value."""
    g = list(group_cols)
    sent = update.select(*g, "param").distinct()
    kept = previous.join(sent, on=[*g, "param"], how="left_anti")
    return kept.unionByName(update.select(*kept.columns))


def global_as_of(sent: DataFrame, weights: DataFrame, run_cols: Sequence[str], last_round: int,
                 client_col: str = "client_id") -> DataFrame:
    """The global state as of every round (trap T3, state as an upsert): per (run, round r,
    param) the weighted average from the latest round s <= r in which the param was sent.
    A parameter is replaced whole, so a later, smaller shape never keeps stale cells."""
    g = list(run_cols)
    avg = weighted_padded_average(sent, weights, [*g, "round"], client_col)
    # the latest round is found on names, one row per (run, round, param); only then do cells join
    names = sent.select(*g, "round", "param").distinct()
    offered = names.withColumn("_as_of", F.explode(F.sequence(F.col("round"), F.lit(last_round))))
    latest = offered.groupBy(*g, "_as_of", "param").agg(F.max("round").alias("round"))
    return (avg.join(latest, on=[*g, "round", "param"])
            .select(*g, F.col("_as_of").alias("round"), *CELL_KEYS, "v"))
