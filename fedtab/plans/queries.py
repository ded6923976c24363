"""Registered queries: one per operator of the inventory, each over whole tables.

Each callable takes (spark, sf_dir) and returns a DataFrame whose column names
match the oracle SQL in ``plans/oracle_sql.py``. Doubles are rounded once, at
the end, so that two engines' summation orders cannot change the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedtab.functions.params import METHODS, component, element_bytes, layer_key, transmits
from fedtab.operators import blocks, cost, evaluate, linalg, report, split, state
from fedtab.plans import fixtures as fx
from fedtab.session import materialize, shared_dir, table
from fedtab.sources import results_io, runlog, text

Query = Callable[[SparkSession, str], DataFrame]
R6 = 6
SEED = fx.SEED
DROP_P = 0.2
COHORT_K = 3
CAP_N = 300
MU = 0.01
REF_ALPHA = 10.0
LOW_ALPHA = 0.1


def _r(c: str, d: int = R6) -> F.Column:
    return F.round(F.col(c), d).alias(c)


# ---------------------------------------------------------------- sources

def q_scan_examples(spark, sf):
    ex = text.scan_examples(fx.v_examples(spark, sf), test_fraction=DROP_P, seed=SEED)
    return ex.select("example_id", "label", "split", F.length("text").cast("long").alias("text_len"))


def _label_dist(spark, sf):
    return split.label_distribution(fx.v_assignment(spark, sf), fx.v_proportions(spark),
                                    labels=[0, 1, 2, 3], names=fx.LABEL_NAMES)


LABEL_DIST_SCHEMA = T.StructType(
    [T.StructField("_idx", T.IntegerType()), T.StructField("client_id", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in fx.LABEL_NAMES])


def q_csv_roundtrip(spark, sf):
    path = shared_dir(spark, "label_dist_csv")
    dist = _label_dist(spark, sf)
    results_io.write_results_csv(dist.select(F.col("client_id").alias("_idx"), "*"), path)
    return results_io.read_results_csv(spark, path, LABEL_DIST_SCHEMA)


def q_parse_run_log(spark, sf):
    return runlog.parse_run_log(fx.v_run_log(spark, sf))


def q_parse_run_log_last_block(spark, sf):
    """#3 with the reference's overwrite semantics (trap T20, ``last_block_only``)."""
    return runlog.parse_run_log(fx.v_run_log(spark, sf), last_block_only=True)


def q_run_log_unmatched(spark, sf):
    """Trap T16: round lines the record pattern rejects (nan values), per log."""
    return runlog.unmatched_round_lines(fx.v_run_log(spark, sf))


def q_parse_run_log_text(spark, sf):
    """#3 from text files: the logs written as text, read with their line order and parsed."""
    path = shared_dir(spark, "log_text")
    runlog.write_log_text(fx.v_run_log(spark, sf), path)
    return runlog.parse_run_log(runlog.read_log_text(spark, path))


def q_checkpoint_roundtrip(spark, sf):
    """#5/#6: the state of all runs committed, one round committed again, all of it read back and summarised."""
    path = shared_dir(spark, "checkpoint")
    parts = {k: materialize(v, f"checkpoint-{k}") for k, v in fx.v_checkpoint(spark, sf).items()}
    results_io.write_checkpoint(parts, path)
    again = {k: v.filter((F.col("method") == "rolora") & (F.col("round") == 3)) for k, v in parts.items()}
    results_io.write_checkpoint(again, path)
    back = results_io.read_checkpoint(spark, path)
    g = ["method", "alpha", "round"]
    there = F.filter("v", lambda x: x.isNotNull())
    cells = back["cells"].groupBy(*g).agg(F.sum(F.size(there)).alias("n_cells"),
                                          F.sum(F.aggregate(there, F.lit(0.0), lambda a, x: a + x)).alias("sum_v"))
    return (cells.join(back["metrics"], g).join(back["communication"], g).join(back["bias"], g).join(back["config"], g)
            .select("method", F.col("alpha").cast("double").alias("alpha"), F.col("round").cast("int").alias("round"), "n_cells",
                    _r("sum_v"), "acc", "f1", "loss", "comm_mb", "bias", "config", "seed"))


def q_state_roundtrip(spark, sf):
    path = shared_dir(spark, "round_state")
    results_io.write_round_state(fx.v_cells_rounds(spark, sf), path)
    back = results_io.read_round_state(spark, path, method="rolora", round=3)
    return back.select("client_id", "param", "i", "j", _r("v"))


def q_tokenize_pad(spark, sf):
    ex = fx.v_examples(spark, sf)
    vocab = text.build_vocabulary(ex)
    tok = text.tokenize_pad(ex, vocab)
    n = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.col("input_ids")
    return tok.select(
        "example_id", "labels", "n_words", "chunk_no", n.alias("n_tokens"),
        (F.lit(text.MAX_SEQ_LENGTH).cast("long") - n).alias("n_pad"),
        F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"),
        F.when(n > 0, ids[0]).alias("first_id"),
        F.when(n > 0, F.element_at(ids, n.cast("int"))).alias("last_id"))


# ---------------------------------------------------------------- names

def q_param_component(spark, sf):
    return fx.v_param_meta(spark, sf).select("client_id", "param", component("param").alias("component"))


def q_transmit_filter(spark, sf):
    c = fx.v_cells_rounds(spark, sf).filter(transmits("param", "method", "round"))
    return (c.groupBy("method", "round", "param")
            .agg(F.count(F.lit(1)).alias("n_cells"), F.sum("v").alias("sum_v"))
            .select("method", "round", "param", "n_cells", _r("sum_v")))


def q_layer_key(spark, sf):
    return fx.v_param_meta(spark, sf).select("client_id", "param", layer_key("param").alias("layer"))


def q_element_bytes(spark, sf):
    return fx.v_param_meta(spark, sf).select("client_id", "param",
                                             element_bytes("dtype", "n_rows", "n_cols").alias("n_bytes"))


# ---------------------------------------------------------------- sampling and splits

def _user_days(spark, sf):
    return (table(spark, sf, "events")
            .select(F.col("user_id").alias("client_id"), F.dayofmonth("ts").cast("int").alias("round"))
            .distinct())


def q_hash_bernoulli(spark, sf):
    return split.hash_bernoulli_drop(_user_days(spark, sf), ["round", "client_id"], DROP_P, SEED)


def q_cohort_sample(spark, sf):
    s = split.cohort_sample(_user_days(spark, sf), "round", "client_id", COHORT_K, SEED)
    return s.select("round", "client_id", F.col("pick").cast("long").alias("pick"))


def q_dirichlet_proportions(spark, sf):
    p = split.dirichlet_proportions(fx.v_examples(spark, sf), "label", fx.NUM_CLIENTS, alpha=0.5, seed=SEED)
    return p.select("label", "client_id", _r("p"))


def q_hash_split(spark, sf):
    """#15 in hash mode: no positions, the row's hash against its class's cumulative shares."""
    return split.hash_split(fx.v_examples(spark, sf), fx.v_proportions(spark), "p1000", SEED)


def q_proportional_split(spark, sf):
    return fx.v_assignment(spark, sf)


def q_cumulative_boundaries(spark, sf):
    n = fx.v_examples(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    b = split.cumulative_boundaries(fx.v_proportions(spark), "p1000").join(n, "label")
    return b.select("label", "client_id", "n",
                    F.expr("(lo * n) div total").cast("long").alias("lo_pos"),
                    F.expr("(hi * n) div total").cast("long").alias("hi_pos"))


def q_shuffle_within_group(spark, sf):
    return split.shuffle_within_group(fx.v_assignment(spark, sf), "client_id", "example_id", SEED) \
        .select("example_id", "client_id", "pos")


def q_cap_per_group(spark, sf):
    return split.cap_per_group(fx.v_assignment(spark, sf), "client_id", "example_id", CAP_N, SEED) \
        .select("client_id", "example_id")


def q_label_distribution(spark, sf):
    return _label_dist(spark, sf)


def q_label_distribution_quality(spark, sf):
    """#22 on the two-class label: clients x quality, zero-filled, every client present."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("example_id"), "quality")
    q = (fx.v_assignment(spark, sf).join(lab, "example_id", "left")
         .select("client_id", F.coalesce("quality", F.lit(-1)).alias("label")))
    return split.label_distribution(q, fx.v_proportions(spark), labels=[0, 1, -1], names=["low", "high", "unlabelled"])


def q_quality_metrics(spark, sf):
    """#33 on the two-class label per client: truth = quality, prediction = not toxic; rows without a label are counted."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("example_id"), "quality", "toxic")
    q = fx.v_assignment(spark, sf).join(lab, "example_id", "left").select(
        "client_id", F.col("quality").alias("label"), (F.lit(1) - F.col("toxic")).alias("pred"))
    m = evaluate.classification_metrics(q.where("label is not null"), ["client_id"], loss_col=None)
    rest = q.groupBy("client_id").agg(F.sum(F.col("label").isNull().cast("long")).alias("n_unlabelled"))
    return m.join(rest, "client_id").select("client_id", "n", "n_unlabelled", _r("accuracy"), _r("macro_f1"), "n_classes")


# ---------------------------------------------------------------- state and averaging

def _weights(spark, sf):
    return state.group_weight(fx.v_client_meta(spark, sf))


def q_group_weight(spark, sf):
    return _weights(spark, sf).select("client_id", "n_samples", _r("weight"))


def q_weighted_padded_average(spark, sf):
    avg = state.weighted_padded_average(fx.v_cells(spark, sf), _weights(spark, sf))
    return avg.select("param", "i", "j", _r("v"))


def q_param_max_shape(spark, sf):
    return state.param_max_shape(fx.v_param_meta(spark, sf))


def _round_state(spark, sf, method: str, rnd: int):
    c = fx.v_cells_rounds(spark, sf)
    return (c.filter((F.col("method") == method) & (F.col("round") == rnd))
            .filter(transmits("param", "method", "round")).drop("method", "round"))


def q_state_overlay(spark, sf):
    glob = state.weighted_padded_average(_round_state(spark, sf, "rolora", 1), _weights(spark, sf))
    out = state.state_overlay(fx.v_cells(spark, sf), glob)
    return out.select("client_id", "param", "i", "j", _r("v"))


def q_key_presence_filter(spark, sf):
    cells = _round_state(spark, sf, "standard_lora", 2)
    kept = state.key_presence_filter(cells, _round_state(spark, sf, "rolora", 1))
    return (kept.groupBy("client_id", "param").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("v").alias("sum_v"))
            .select("client_id", "param", "n_cells", _r("sum_v")))


# ---------------------------------------------------------------- the same on blocked tensors

def q_blocked_average(spark, sf):
    """#24 on blocked tensors: the same cells as ``weighted_padded_average``."""
    parts, names = fx.v_blocks(spark, sf)
    avg = blocks.average_blocks(parts, _weights(spark, sf))
    return blocks.to_cells(avg, names).select("param", "i", "j", _r("v"))


def q_blocked_overlay(spark, sf):
    """#19 on blocked tensors: the same cells as ``state_overlay``."""
    parts, names = fx.v_blocks(spark, sf)
    first = fx.sent_blocks(parts, names).where("method = 'rolora' and round = 1").drop("method", "round")
    out = blocks.overlay_blocks(parts, blocks.average_blocks(first, _weights(spark, sf)))
    return blocks.to_cells(out, names).select("client_id", "param", "i", "j", _r("v"))


def q_blocked_presence(spark, sf):
    """#20 on blocked tensors: the same tensors as ``key_presence_filter``."""
    parts, names = fx.v_blocks(spark, sf)
    sent = fx.sent_blocks(parts, names)
    kept = blocks.present_blocks(sent.where("method = 'standard_lora' and round = 2"), sent.where("method = 'rolora' and round = 1"))
    kept = kept.join(names.select("param_id", "param"), "param_id")
    there = F.filter("v", lambda x: x.isNotNull())
    return (kept.groupBy("client_id", "param")
            .agg(F.sum(F.size(there)).cast("long").alias("n_cells"),
                 F.sum(F.aggregate(there, F.lit(0.0), lambda a, x: a + x)).alias("sum_v"))
            .select("client_id", "param", "n_cells", _r("sum_v")))


def q_blocked_max_shape(spark, sf):
    """#25 on blocked tensors: the same shapes as ``param_max_shape``."""
    parts, names = fx.v_blocks(spark, sf)
    return blocks.max_shapes(parts, names).select("param", "n_rows", "n_cols", "n_clients")


# ---------------------------------------------------------------- products and bias

def _cells(spark, sf):
    """The cell table, derived once per query (read several times by the plan)."""
    return materialize(fx.v_cells(spark, sf), "cells")


def q_matrix_product(spark, sf):
    return linalg.matrix_product(_cells(spark, sf), ["client_id"]).select(
        "client_id", "layer", "i", "j", _r("w"))


def q_mean_product(spark, sf):
    return linalg.mean_product(_cells(spark, sf), _weights(spark, sf)).select("layer", "i", "j", _r("w"))


def q_aggregation_bias(spark, sf, weighted: bool = False, max_layers: int | None = None):
    b = linalg.aggregation_bias_layers(_cells(spark, sf), _weights(spark, sf), weighted=weighted,
                                       max_layers=max_layers)
    return b.select("layer", _r("bias"))


def q_aggregation_bias_sampled(spark, sf):
    """#27 on an even sample of four layers (#28), asked for explicitly."""
    return q_aggregation_bias(spark, sf, max_layers=4)


def q_aggregation_bias_weighted(spark, sf):
    return q_aggregation_bias(spark, sf, weighted=True)


def q_aggregation_bias_gram(spark, sf):
    """#27 by Gram matrices of blocked factors: the same ratios as ``aggregation_bias``."""
    parts, names = fx.v_blocks(spark, sf)
    return blocks.gram_bias_layers(parts, names, _weights(spark, sf)).select("layer", _r("bias"))


def q_round_bias(spark, sf):
    """Flagship: per (method, round), transmitted factors -> weighted average -> bias, on blocked tensors."""
    parts, names = fx.v_blocks(spark, sf)
    sent = materialize(fx.sent_blocks(parts, names), "sent-blocks")
    g = ["method", "round"]
    per_layer = blocks.gram_bias_layers(sent, names, _round_weights(spark, sf), g)
    out = linalg.summarise_bias(per_layer, sent.select(*g).distinct(), g)
    return out.select("method", "round", _r("bias"), "n_layers_measured")


def _round_weights(spark, sf):
    """Per (method, round): every client, weighted by its sample count."""
    meta = fx.v_client_meta(spark, sf)
    return state.group_weight(
        meta.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
            .withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(fx.ROUNDS)))),
        partition_cols=["method", "round"])


def q_round_bias_carry_frozen(spark, sf):
    """#27 with carry_frozen: a factor not sent in a round is the shared global one from
    the latest round that sent it (un-averaged, cropped per client); measured on blocked tensors."""
    g = ["method", "round"]
    parts, names = fx.v_blocks(spark, sf)
    sent = materialize(fx.sent_blocks(parts, names), "sent-blocks")
    weights = _round_weights(spark, sf)
    frozen = materialize(blocks.blocks_as_of(sent, weights, ["method"], fx.ROUNDS), "global_as_of")
    per_layer = blocks.frozen_gram_bias_layers(sent, frozen, names, weights, g)
    out = linalg.summarise_bias(per_layer, sent.select(*g).distinct(), g)
    return out.select("method", "round", _r("bias"), "n_layers_measured")


def q_even_layer_sample(spark, sf):
    return linalg.even_layer_sample(fx.v_layers(spark, sf), 4)


# ---------------------------------------------------------------- communication

def q_communication_cost(spark, sf):
    c = cost.communication_cost(fx.v_param_meta(spark, sf), ["client_id"])
    return c.select("client_id", _r("total_mb"), _r("lora_a_mb"), _r("lora_b_mb"), _r("head_mb"), "n_values")


def participants(spark, sf):
    """Per round: cohort of COHORT_K clients, then dropout with DROP_P (independent seed)."""
    cand = (fx.v_client_meta(spark, sf).select("client_id")
            .withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(fx.ROUNDS)))))
    cohort = split.cohort_sample(cand, "round", "client_id", COHORT_K, SEED)
    return split.hash_bernoulli_drop(cohort, ["round", "client_id"], DROP_P, SEED + 1).select("round", "client_id")


def q_round_communication(spark, sf):
    rc = cost.round_communication(fx.v_param_meta(spark, sf), participants(spark, sf), METHODS)
    return rc.select("method", "round", "n_clients", *[_r(c) for c in
                     ("upload_mb", "download_mb", "round_mb", "lora_a_mb", "lora_b_mb", "head_mb")])


def q_cumulative_communication(spark, sf):
    c = cost.cumulative_communication(fx.v_round_metrics(spark, sf), mb_col="comm_mb")
    return c.select("method", "alpha", "round", "comm_mb", _r("cumulative_mb", 4))


# ---------------------------------------------------------------- evaluation

def q_score_argmax_loss(spark, sf):
    s = evaluate.score_argmax_loss(fx.v_predictions(spark, sf))
    return s.select("example_id", "label", "pred", _r("loss"))


def q_classification_metrics(spark, sf):
    m = evaluate.classification_metrics(evaluate.score_argmax_loss(fx.v_predictions(spark, sf)))
    return m.select("n", _r("accuracy"), _r("macro_f1"), "n_classes", _r("mean_loss"))


# ---------------------------------------------------------------- run analytics

def _final(spark, sf):
    return fx.v_final_results(spark, sf)


def q_run_summary(spark, sf):
    f = _final(spark, sf)
    return f.select("method", "alpha", "final_acc", "final_f1", "final_loss", "best_acc", "best_f1",
                    _r("total_comm_mb", 4), _r("mean_bias"))


def q_accuracy_matrix(spark, sf):
    return report.accuracy_matrix(_final(spark, sf))


def q_efficiency_frontier(spark, sf):
    f = _final(spark, sf).withColumn("total_comm_mb", F.round("total_comm_mb", 4))
    return report.efficiency_frontier(f).select("method", "alpha", "total_comm_mb", "final_acc", "on_frontier")


def q_convergence_curves(spark, sf):
    return report.convergence_curves(fx.v_round_metrics(spark, sf)).select(
        "alpha", "method", "round", "acc", _r("delta_acc"))


def q_comm_totals(spark, sf):
    return report.comm_totals(fx.v_round_metrics(spark, sf), REF_ALPHA).select("method", _r("total_comm_mb", 4))


def q_bias_curves(spark, sf):
    return report.bias_curves(fx.v_round_metrics(spark, sf), REF_ALPHA)


def q_comm_saving(spark, sf):
    s = report.comm_saving(fx.v_round_metrics(spark, sf))
    return s.select("method", "alpha", _r("total_comm_mb", 4), _r("mean_round_mb"), _r("saving_pct"))


def q_degradation_report(spark, sf):
    d = report.degradation_report(fx.v_round_metrics(spark, sf), fx.v_run_uploads(spark, sf))
    return d.select("method", _r("degradation_pts"), _r("acc_std_low_alpha"), "n_rounds_low_alpha", "n_uploads", "min_uploads",
                    "n_rounds_without")


def q_run_comparison(spark, sf):
    f = _final(spark, sf)
    c = report.run_comparison(f.filter(F.col("alpha") == REF_ALPHA), f.filter(F.col("alpha") == LOW_ALPHA))
    return c.select("method", "final_acc_a", "final_acc_b", _r("diff"))


# ---------------------------------------------------------------- local training

def q_proximal_penalty(spark, sf):
    from fedtab.operators.fit import proximal_penalty
    glob = state.weighted_padded_average(_round_state(spark, sf, "standard_lora", 1), _weights(spark, sf))
    p = proximal_penalty(fx.v_cells(spark, sf), glob, MU)
    return p.select("client_id", _r("penalty"))


def q_local_gradient(spark, sf):
    from fedtab.operators.fit import local_gradient
    g = local_gradient(fx.v_features(spark, sf), num_classes=4)
    return g.select("client_id", "class", "j", _r("grad"))


def q_local_fit(spark, sf):
    from fedtab.operators.fit import local_fit_summary
    s = local_fit_summary(fx.v_features(spark, sf), num_classes=4, dim=64)
    return s.select("client_id", "n_rows", _r("first_loss"), _r("last_loss"), _r("norm2"))


def q_low_rank_fit(spark, sf):
    """#46: one epoch of every client under each method in the first two rounds, from one given global state.

    In the second round B starts from a table, too, so that the factor A, which that round trains, has a slope.
    """
    from fedtab.operators import lowrank
    rows = split.shuffle_within_group(fx.v_features(spark, sf), "client_id", "example_id", SEED)
    rows = materialize(lowrank.in_batches(rows.select("client_id", "y", "x", "pos")), "fit-rows")
    ranked = rows.select("client_id").distinct().withColumn("rank", fx.client_rank())
    start = lowrank.first_state(ranked, 4, 64, SEED)
    later = start.withColumn("b", F.transform("b", lambda r, k: F.transform(r, lambda _, j: lowrank.table_value(
        SEED, "B", k, j, 0.1)))).withColumn("round", F.lit(2))
    start = (start.withColumn("round", F.lit(1)).unionByName(later)
             .withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS]))))
    keys = ["method", "round", "client_id"]
    fitted = lowrank.fit_factors(rows, start, steps=-(-lowrank.BATCHES // lowrank.ACCUMULATE), keys=keys)

    def norm(c: str) -> F.Column:
        return F.aggregate(F.flatten(c), F.lit(0.0), lambda s, v: s + v * v)
    return fitted.select(*keys, "n_rows", "n_steps", F.round("mean_loss", R6).alias("mean_loss"), "n_nan",
                         *[F.round(norm(n), R6).alias(f"norm2_{n}") for n in lowrank.PARAMS])


def q_round_report(spark, sf):
    """#47: what the clients sent, averaged, measured and evaluated on the held-out vectors; on blocked tensors."""
    from fedtab.plans.round_report import round_report_blocks
    parts, names = fx.v_blocks(spark, sf)
    report_ = round_report_blocks(fx.sent_blocks(parts, names), names, fx.v_client_meta(spark, sf), fx.v_held_out(spark, sf))
    return report_.select("method", "round", "n_clients", _r("upload_mb"), _r("download_mb"), _r("round_mb"), _r("bias"),
                          "n_layers_measured", "n_held_out", _r("accuracy"), _r("macro_f1"), _r("mean_loss"))


# ---------------------------------------------------------------- streaming

def q_stream_log_rounds(spark, sf):
    from fedtab.streaming.log_stream import stream_log_rounds
    out = stream_log_rounds(spark, fx.v_run_log(spark, sf))
    return out.select("run_id", "line_no", "round", "acc", "f1", "loss", "comm_mb", "bias")


def _log_source(spark, sf, base: str) -> str:
    return fx.land_in_order(fx.v_run_log(spark, sf), ["line_no", "run_id"], f"{base}/source")


def q_stream_log_with_context(spark, sf):
    from fedtab.streaming.log_context_stream import stream_log_with_context
    base = shared_dir(spark, "log_context_stream")
    out = stream_log_with_context(spark, _log_source(spark, sf, base), base)
    return out.select("run_id", "alpha_block", "alpha_txt", "alpha", "method", "line_no", *runlog.ROUND_FIELDS)


def q_dropped_clients(spark, sf):
    """#48 on ``[DROPOUT]`` lines: who dropped out of every round of every log."""
    return runlog.dropped_clients(fx.v_run_log(spark, sf))


def q_stream_dropped_clients(spark, sf):
    """The same from a growing log; a round is written when its line arrives."""
    from fedtab.streaming.log_context_stream import stream_dropped_clients
    base = shared_dir(spark, "dropout_stream")
    return stream_dropped_clients(spark, _log_source(spark, sf, base), base)


def q_stream_round_average(spark, sf):
    from fedtab.streaming.round_stream import stream_round_average
    base = shared_dir(spark, "round_stream")
    src = fx.land_in_order(fx.v_uploads(spark, sf), ["arrival_ts", "event_id"], f"{base}/source")
    out = stream_round_average(spark, src, base)
    return out.select("round_start", "n", "sum_w", _r("sum_wv"), _r("avg_v"))


def q_stream_state_average(spark, sf):
    """#49 on parameter states: per round the padded average of what arrived before the deadline."""
    from fedtab.streaming.round_stream import read_state_average, run_state_average
    base = shared_dir(spark, "state_stream")
    uploads, names = fx.v_state_uploads(spark, sf)
    src = fx.land_in_order(uploads, ["arrival_ts", "client_id", "param_id", "k", "t"], f"{base}/source")
    run_state_average(spark, src, base)
    avg = blocks.to_cells(read_state_average(spark, base), names)
    return avg.select(F.date_format("round_start", "yyyy-MM-dd HH:mm:ss").alias("round_start"), "n_clients", "param", "i", "j", _r("v"))


QUERIES: dict[str, Query] = {
    "scan_examples": q_scan_examples,
    "csv_roundtrip": q_csv_roundtrip,
    "parse_run_log": q_parse_run_log,
    "parse_run_log_last_block": q_parse_run_log_last_block,
    "run_log_unmatched": q_run_log_unmatched,
    "parse_run_log_text": q_parse_run_log_text,
    "checkpoint_roundtrip": q_checkpoint_roundtrip,
    "state_roundtrip": q_state_roundtrip,
    "tokenize_pad": q_tokenize_pad,
    "param_component": q_param_component,
    "transmit_filter": q_transmit_filter,
    "layer_key": q_layer_key,
    "element_bytes": q_element_bytes,
    "hash_bernoulli": q_hash_bernoulli,
    "cohort_sample": q_cohort_sample,
    "dirichlet_proportions": q_dirichlet_proportions,
    "proportional_split": q_proportional_split,
    "hash_split": q_hash_split,
    "cumulative_boundaries": q_cumulative_boundaries,
    "shuffle_within_group": q_shuffle_within_group,
    "cap_per_group": q_cap_per_group,
    "label_distribution": q_label_distribution,
    "label_distribution_quality": q_label_distribution_quality,
    "quality_metrics": q_quality_metrics,
    "group_weight": q_group_weight,
    "weighted_padded_average": q_weighted_padded_average,
    "param_max_shape": q_param_max_shape,
    "state_overlay": q_state_overlay,
    "key_presence_filter": q_key_presence_filter,
    "blocked_average": q_blocked_average,
    "blocked_overlay": q_blocked_overlay,
    "blocked_presence": q_blocked_presence,
    "blocked_max_shape": q_blocked_max_shape,
    "aggregation_bias_gram": q_aggregation_bias_gram,
    "matrix_product": q_matrix_product,
    "mean_product": q_mean_product,
    "aggregation_bias": q_aggregation_bias,
    "aggregation_bias_weighted": q_aggregation_bias_weighted,
    "aggregation_bias_sampled": q_aggregation_bias_sampled,
    "round_bias": q_round_bias,
    "round_bias_carry_frozen": q_round_bias_carry_frozen,
    "even_layer_sample": q_even_layer_sample,
    "communication_cost": q_communication_cost,
    "round_communication": q_round_communication,
    "cumulative_communication": q_cumulative_communication,
    "score_argmax_loss": q_score_argmax_loss,
    "classification_metrics": q_classification_metrics,
    "run_summary": q_run_summary,
    "accuracy_matrix": q_accuracy_matrix,
    "efficiency_frontier": q_efficiency_frontier,
    "convergence_curves": q_convergence_curves,
    "comm_totals": q_comm_totals,
    "bias_curves": q_bias_curves,
    "comm_saving": q_comm_saving,
    "degradation_report": q_degradation_report,
    "run_comparison": q_run_comparison,
    "proximal_penalty": q_proximal_penalty,
    "local_gradient": q_local_gradient,
    "local_fit": q_local_fit,
    "low_rank_fit": q_low_rank_fit,
    "round_report": q_round_report,
    "stream_log_rounds": q_stream_log_rounds,
    "stream_log_with_context": q_stream_log_with_context,
    "dropped_clients": q_dropped_clients,
    "stream_dropped_clients": q_stream_dropped_clients,
    "stream_round_average": q_stream_round_average,
    "stream_state_average": q_stream_state_average,
}
