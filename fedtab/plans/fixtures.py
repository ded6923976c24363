"""Test bindings: the given tables re-read as the data the operators work on.

Every view reads the whole of its source table, so its size grows with the
scale factor. The DuckDB twin of each view lives in ``plans/oracle_sql.py``.

* documents  -> labelled examples (``lang`` plays the 4-class label)
* embeddings -> per-client low-rank parameter cells: every vector of client k
  (= ``label``) becomes one row of some layer's A factor, one column of its B
  factor, or one row of its head, in vector-id order
* events     -> round metrics, run logs and timed uploads
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedtab.functions.params import METHODS, transmits
from fedtab.operators.positions import group_positions, int_bucket
from fedtab.session import table

# Label of each document language; the client-by-label split
# proportions, in thousandths (5 clients x 4 labels).
LANG_LABELS = {"de": 0, "en": 1, "es": 2}  # every other language -> 3
LABEL_NAMES = ["World", "Sports", "Business", "Sci/Tech"]
PROPORTIONS_1000 = [
    (0, 0, 100), (0, 1, 250), (0, 2, 50), (0, 3, 0), (0, 4, 600),
    (1, 0, 200), (1, 1, 200), (1, 2, 200), (1, 3, 200), (1, 4, 200),
    (2, 0, 700), (2, 1, 5), (2, 2, 95), (2, 3, 100), (2, 4, 100),
    (3, 0, 10), (3, 1, 10), (3, 2, 10), (3, 3, 960), (3, 4, 10),
]
NUM_CLIENTS = 5
HEAD_ROWS = 4
ROUNDS = 5
SEED = 42
FIRST_DAY = 1704067200  # 2024-01-01 in seconds


def client_rank(client_id: str = "client_id") -> F.Column:
    """Ranks 4 for clients 0-3, 8 for the rest (the 4,4,8,8,8 pattern, widened)."""
    return F.when(F.col(client_id) < 4, F.lit(4)).otherwise(F.lit(8))


def v_examples(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    label = F.lit(3)
    for code, lab in reversed(list(LANG_LABELS.items())):
        label = F.when(lang == code, F.lit(lab)).otherwise(label)
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("example_id"), "text", label.cast("int").alias("label"))


def v_proportions(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("label", T.IntegerType()),
                           T.StructField("client_id", T.IntegerType()),
                           T.StructField("p1000", T.IntegerType())])
    return spark.createDataFrame(PROPORTIONS_1000, schema)


def v_assignment(spark: SparkSession, sf: str) -> DataFrame:
    from fedtab.operators.split import proportional_split
    return proportional_split(v_examples(spark, sf).select("example_id", "label"),
                              v_proportions(spark), weight_col="p1000")


def v_vec(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    ranked = group_positions(emb, ["label"], ["vec_id"], bucket=int_bucket("vec_id"), pos_col="rn")
    return ranked.select(
        F.col("label").alias("client_id"), client_rank("label").alias("rank"), "rn",
        F.posexplode("embedding").alias("pos", "x"),
    ).select("client_id", "rank", "rn", F.col("pos").cast("long").alias("pos"),
             F.col("x").cast("double").alias("v"))


def cells_from_vectors(vec: DataFrame) -> DataFrame:
    """Vector rn of a rank-r client: layer = rn div (2r+4), slot s = rn mod (2r+4);
    s < r -> row s of A (r x d); r <= s < 2r -> column s-r of B (d x r);
    else row s-2r of the layer's head (4 x d)."""
    blk = F.col("rank") * 2 + HEAD_ROWS
    v = vec.select("client_id", "rank", "pos", "v",
                   F.expr("rn div (rank * 2 + 4)").alias("layer"),
                   (F.col("rn") % blk).alias("s"))
    r, s = F.col("rank"), F.col("s")
    suffix = (F.when(s < r, F.lit(".q_proj.lora_A.default.weight"))
              .when(s < r * 2, F.lit(".q_proj.lora_B.default.weight"))
              .otherwise(F.lit(".score.weight")))
    return v.select(
        "client_id",
        F.concat(F.lit("layers."), F.col("layer").cast("string"), suffix).alias("param"),
        F.when(s < r, s).when(s < r * 2, F.col("pos")).otherwise(s - r * 2).cast("int").alias("i"),
        F.when(s < r, F.col("pos")).when(s < r * 2, s - r).otherwise(F.col("pos")).cast("int").alias("j"),
        "v",
    )


def v_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells_from_vectors(v_vec(spark, sf))


def v_cells_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell once per (method, round), scaled per round and client."""
    c = v_cells(spark, sf)
    c = c.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    c = c.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))))
    scale = F.lit(1) + (F.col("round") * (F.col("client_id") + 1)).cast("double") / 100
    return c.select("method", F.col("round").cast("int").alias("round"), "client_id", "param", "i", "j",
                    (F.col("v") * scale).alias("v"))


def v_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of ``v_cells`` as whole vectors ``(client_id, param, k, x)``: row k of A or of a head, column k of B."""
    emb = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    ranked = group_positions(emb, ["label"], ["vec_id"], bucket=int_bucket("vec_id"), pos_col="rn")
    r, s = F.col("rank"), F.col("s")
    v = ranked.withColumn("rank", client_rank("label")).withColumn("s", F.col("rn") % (r * 2 + HEAD_ROWS))
    suffix = (F.when(s < r, F.lit(".q_proj.lora_A.default.weight"))
              .when(s < r * 2, F.lit(".q_proj.lora_B.default.weight")).otherwise(F.lit(".score.weight")))
    return v.select(
        F.col("label").alias("client_id"),
        F.concat(F.lit("layers."), F.expr("rn div (rank * 2 + 4)").cast("string"), suffix).alias("param"),
        F.when(s < r, s).when(s < r * 2, s - r).otherwise(s - r * 2).cast("int").alias("k"),
        F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def v_blocks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The states as blocked tensors ``(client_id, param_id, k, t, v)`` and their names; both written once."""
    from fedtab.operators import blocks
    from fedtab.session import materialize
    vectors = v_vectors(spark, sf)
    names = materialize(blocks.name_dimension(vectors), "names")
    return materialize(blocks.blocks_of_vectors(vectors, ["client_id"], names), "blocks"), names


def sent_blocks(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """What each method sends of the blocks in each round, scaled as in ``v_cells_rounds``."""
    c = each_round(blocks.join(names.select("param_id", "param"), "param_id")).where(transmits("param", "method", "round"))
    return scaled(c.drop("param"))


def each_round(blocks: DataFrame) -> DataFrame:
    """Each block once per (method, round)."""
    c = blocks.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    return c.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))))


def scaled(blocks: DataFrame) -> DataFrame:
    by = F.lit(1) + (F.col("round") * (F.col("client_id") + 1)).cast("double") / 100
    return blocks.withColumn("v", F.transform("v", lambda x: x * by))


def v_client_meta(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "embeddings").groupBy(F.col("label").alias("client_id"))
            .agg(F.count(F.lit(1)).alias("n_samples"))
            .select("client_id", client_rank().alias("rank"), "n_samples"))


def param_meta_of(cells: DataFrame) -> DataFrame:
    return (cells.groupBy("client_id", "param")
            .agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"))
            .withColumn("dtype", F.when(F.col("client_id") % 2 == 0, F.lit("float32")).otherwise(F.lit("float16"))))


def v_param_meta(spark: SparkSession, sf: str) -> DataFrame:
    return param_meta_of(v_cells(spark, sf))


def v_layers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("layer")).distinct()


def v_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Four logits from the whole vector: logit k sums the values at positions k, k + 4, k + 8, ..."""
    def logit(k: int) -> F.Column:
        own = F.filter("embedding", lambda x, i: i % 4 == k)
        return F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("example_id"), (F.col("label") % 4).cast("int").alias("label"),
        F.array(*[logit(k) for k in range(4)]).alias("logits"))


def v_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        (F.col("label") % 5).cast("int").alias("client_id"), F.col("vec_id").alias("example_id"),
        (F.col("label") % 4).cast("int").alias("y"),
        F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def v_held_out(spark: SparkSession, sf: str) -> DataFrame:
    """The test split of the vectors (#1's hash split), for evaluation only."""
    from fedtab.functions.hashing import bernoulli
    return table(spark, sf, "embeddings").filter(bernoulli(SEED, 0.2, "vec_id")).select(
        F.col("vec_id").alias("example_id"), (F.col("label") % 4).cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def v_checkpoint(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The parts of a full round state of all runs; the parameter state as blocked tensors under their names."""
    rounds = v_round_metrics(spark, sf)
    g = ["method", "alpha", "round"]
    blocks, names = v_blocks(spark, sf)
    state = scaled(each_round(blocks.join(names.select("param_id", "param"), "param_id").drop("param_id")))
    state = state.withColumn("alpha", F.explode(F.array(F.lit(10.0), F.lit(0.5), F.lit(0.1))))
    return {"cells": state, "metrics": rounds.select(*g, "acc", "f1", "loss"),
            "communication": rounds.select(*g, "comm_mb"), "bias": rounds.select(*g, "bias"),
            "config": rounds.select(*g, F.concat(F.lit("clients="), F.lit(NUM_CLIENTS), F.lit(";method="), "method").alias("config"),
                                    F.lit(SEED).alias("seed"))}


def _method_of(user: F.Column) -> F.Column:
    return (F.when(user % 3 == 0, F.lit("standard_lora")).when(user % 3 == 1, F.lit("ffa_lora"))
            .otherwise(F.lit("rolora")))


def _alpha_of(user: F.Column) -> F.Column:
    blk = F.floor(user / 3).cast("int") % 3
    return F.when(blk == 0, F.lit(10.0)).when(blk == 1, F.lit(0.5)).otherwise(F.lit(0.1)).cast("double")


def _flag(cond: F.Column) -> F.Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("double")


def v_round_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    u = F.col("user_id")
    t = F.col("event_type")
    return (ev.groupBy(_method_of(u).alias("method"), _alpha_of(u).alias("alpha"),
                       (F.col("event_id") % 5 + 1).cast("int").alias("round"))
            .agg(F.round(F.avg(_flag(t.isin("click", "view"))), 6).alias("acc"),
                 F.round(F.avg(_flag(t == "purchase")), 6).alias("f1"),
                 F.round(F.avg("value"), 6).alias("loss"),
                 F.round(F.sum("value"), 4).alias("comm_mb"),
                 F.round(F.avg(_flag(t == "error")), 6).alias("bias")))


def v_run_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Updates that arrived, per run and round: purchases of a run's users; users who only looked dropped out."""
    ev = table(spark, sf, "events")
    u = F.col("user_id")
    return ev.where(F.col("event_type") == "purchase").select(
        _method_of(u).alias("method"), _alpha_of(u).alias("alpha"), (F.col("event_id") % 5 + 1).cast("int").alias("round"),
        u.alias("client_id"))


def v_final_results(spark: SparkSession, sf: str) -> DataFrame:
    from fedtab.operators.report import run_summary
    return run_summary(v_round_metrics(spark, sf))


def _lpad_mod(expr: F.Column, n: int) -> F.Column:
    return F.lpad(expr.cast("string"), n, "0")


def v_run_log(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    e = F.col("event_id")
    m3 = e % 3
    alpha_txt = F.when(m3 == 0, F.lit("10.0")).when(m3 == 1, F.lit("0.5")).otherwise(F.lit("0.1"))
    method_txt = (F.when(m3 == 0, F.lit("standard_lora")).when(m3 == 1, F.lit("ffa_lora"))
                  .otherwise(F.lit("rolora")))
    loss = F.when(e % 50 == 0, F.lit("nan")).otherwise(F.concat(F.lit("1."), _lpad_mod(e * 3 % 10000, 4)))
    round_line = F.concat(
        F.lit("Round "), (e % 5 + 1).cast("string"), F.lit(" - Acc: 0."), _lpad_mod(e % 10000, 4),
        F.lit(", F1: 0."), _lpad_mod(e * 7 % 10000, 4), F.lit(", Loss: "), loss,
        F.lit(", Comm: 46."), _lpad_mod(e % 100, 2), F.lit("MB, Bias: 0."), _lpad_mod(e % 1000000, 6))
    t = F.col("event_type")
    line = (F.when(t == "signup", F.concat(F.lit("Starting Alpha: "), alpha_txt))
            .when(t == "view", F.concat(F.lit("--- Method: "), method_txt, F.lit(" ---")))
            .when(t == "error", F.concat(F.lit("  [DROPOUT] Client "), (e % 5).cast("string"),
                                         F.lit(" failed to upload updates.")))
            .otherwise(round_line))
    return ev.select((F.col("user_id") % 9).cast("int").alias("run_id"), e.alias("line_no"), line.alias("line"))


def v_uploads(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    delay = (F.col("event_id") * 7919 % 90000).cast("int")
    ts = F.col("ts").cast("timestamp")
    return ev.select("event_id", ts.alias("ts"),
                     (ts + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), delay))
                     .alias("arrival_ts"),
                     F.col("user_id").alias("client_id"), (F.col("user_id") % 3 + 1).cast("int").alias("w"),
                     F.col("value").alias("v"))


def v_state_uploads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every client's blocks once a round as timed uploads, some of them late, and their names.

    One more upload without tensors, long after the last round, closes it.
    """
    blocks, names = v_blocks(spark, sf)
    sent = scaled(blocks.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS)))))
    c, r = F.col("client_id"), F.col("round")
    ts = F.timestamp_seconds(F.lit(FIRST_DAY) + (r - 1) * 86400 + (c * 7919 + r * 104729) % 86400)
    delay = ((c * 37 + r * 53) % 40 * 1800).cast("int")
    timed = (sent.join(v_client_meta(spark, sf).select("client_id", "n_samples"), "client_id")
             .withColumn("ts", ts).withColumn("arrival_ts", ts + F.make_interval(secs=delay))
             .select("ts", "arrival_ts", F.col("client_id").cast("long").alias("client_id"), "n_samples", "param_id", "k", "t", "v"))
    end = F.timestamp_seconds(F.lit(FIRST_DAY + 30 * 86400))
    closing = spark.range(1).select(end.alias("ts"), end.alias("arrival_ts"), *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in timed.schema.fields[2:]])
    return timed.unionByName(closing), names


def land_in_order(rows: DataFrame, order: list[str], path: str) -> str:
    """Append rows to a source as files that have come in this order: one sorted write, then the files' times.

    A file source takes files by their times. Only file names reach the driver.
    """
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda: {f.getPath().getName(): f.getPath() for f in (fs.listStatus(at) if fs.exists(at) else ())}
    before = there()
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").parquet(path)
    new = sorted(n for n in there() if n.startswith("part-") and n not in before)
    for i, name in enumerate(new):
        fs.setTimes(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), (FIRST_DAY + len(before) + i) * 1000, -1)
    return path
