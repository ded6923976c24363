"""One table over given rounds (#47): weights, average, bias, cost and held-out evaluation.

Input is what clients have sent, one row per cell, for any number of runs and
rounds; nothing is drawn or trained here and no model passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedtab.functions.params import MB, is_head
from fedtab.operators import blocks, evaluate, fit, linalg, state
from fedtab.session import materialize


def round_report(cells: DataFrame, meta: DataFrame, held_out: DataFrame, group_cols: Sequence[str] = ("method", "round"),
                 value_bytes: int = 4) -> DataFrame:
    """One row per group: clients, upload and download MB, bias, and accuracy, macro-F1 and loss on ``held_out``.

    ``cells`` = (group..., client_id, param, i, j, v); ``meta`` = (client_id, n_samples);
    ``held_out`` = (example_id, label, x). All averaged heads score the held-out rows: a
    row's logits are the sum of those of every layer's head, the logits of the heads' sum.
    A group without any head has no scores. A group without cells has no row; an empty table gives an
    empty one of the same columns.
    """
    g = list(group_cols)
    cells = materialize(cells.select(*g, "client_id", "param", "i", "j", "v"), "round_cells")
    sizes = cells.groupBy(*g, "client_id").agg(F.count(F.lit(1)).alias("n_cells"))
    weights = state.group_weight(sizes.join(meta.select("client_id", "n_samples"), "client_id"), partition_cols=g)
    weights = materialize(weights, "round_weights")
    avg = materialize(state.weighted_padded_average(cells, weights, g), "round_average")
    up = sizes.groupBy(*g).agg(F.count(F.lit(1)).alias("n_clients"), F.sum("n_cells").alias("_sent"))
    down = avg.groupBy(*g).agg(F.count(F.lit(1)).alias("_average"))
    bias = linalg.aggregation_bias(cells, weights, up, g)
    head = avg.filter(is_head("param")).groupBy(*g, "i", "j").agg(F.sum("v").alias("v"))
    models = (head.groupBy(*g, "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
              .groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("w"))
              .select(*g, F.transform("w", lambda h: F.transform(h["r"], lambda c: c["v"])).alias("w")))
    return _table(up, down, bias, models, held_out, g, value_bytes)


def round_report_blocks(parts: DataFrame, names: DataFrame, meta: DataFrame, held_out: DataFrame,
                        group_cols: Sequence[str] = ("method", "round"), value_bytes: int = 4) -> DataFrame:
    """``round_report`` on blocked tensors: ``parts`` = (group..., client_id, param_id, k, t, v), ``names`` their dimension.

    The same columns; tiles instead of cells are written and moved, and the bias is the Gram form's. A null value is a
    missing cell.
    """
    g = list(group_cols)
    there = F.size(F.filter("v", lambda x: x.isNotNull()))
    parts = parts.select(*g, "client_id", *blocks.KEYS, "v").where(there > 0)
    parts = materialize(parts, "round_blocks")
    sizes = parts.groupBy(*g, "client_id").agg(F.sum(there).alias("n_cells"))
    weights = state.group_weight(sizes.join(meta.select("client_id", "n_samples"), "client_id"), partition_cols=g)
    weights = materialize(weights, "round_weights")
    avg = materialize(blocks.average_blocks(parts, weights, g).where(there > 0), "round_average")
    up = sizes.groupBy(*g).agg(F.count(F.lit(1)).alias("n_clients"), F.sum("n_cells").alias("_sent"))
    down = avg.groupBy(*g).agg(F.sum(there).alias("_average"))
    bias = linalg.summarise_bias(blocks.gram_bias_layers(parts, names, weights, g), up, g)
    head = blocks.summed_blocks(avg.join(names.where(is_head("param")).select("param_id"), "param_id"), [*g, "k", "t"])
    models = (head.groupBy(*g, "k").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("r"))
              .groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("w"))
              .select(*g, F.transform("w", lambda h: F.filter(F.flatten(F.transform(h["r"], lambda c: c["v"])),
                                                              lambda x: x.isNotNull())).alias("w")))
    return _table(up, down, bias, models, held_out, g, value_bytes)


def _table(up: DataFrame, down: DataFrame, bias: DataFrame, models: DataFrame, held_out: DataFrame, g: list[str],
           value_bytes: int) -> DataFrame:
    """Cost, bias and the models' scores on the held-out rows, one row per group."""
    scored = evaluate.score_argmax_loss(fit.score_with_heads(held_out, materialize(models, "round_heads"), g))
    metrics = evaluate.classification_metrics(scored, g)
    mb = F.lit(float(value_bytes) / MB)
    return (up.join(down, g).join(bias, g).join(metrics, g, "left")
            .select(*g, "n_clients", (F.col("_sent") * mb).alias("upload_mb"), (F.col("_average") * mb).alias("download_mb"),
                    ((F.col("_sent") + F.col("_average") * F.col("n_clients")) * mb).alias("round_mb"),
                    "bias", "n_layers_measured", F.col("n").alias("n_held_out"), "accuracy", "macro_f1", "mean_loss"))
