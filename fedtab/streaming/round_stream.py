"""Per-round weighted average of uploads that arrive over time (#49).

A round is a tumbling window on the upload's event time ``ts``. Whether an
upload counts is an explicit predicate, ``arrival_ts <= window end + grace``
("a late upload is discarded"), so the result does not depend on micro-batch
boundaries. The watermark (delay above the largest admitted lateness) only
bounds the state: uploads arrive in arrival order, so an on-time upload
(arrival <= its round's end + grace) can never be behind the watermark. Output: ``update`` mode into ``foreachBatch``, each batch
written to its own folder (idempotent on retry); the latest row per window wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedtab.operators.blocks import KEYS, WIDTH

ROUND_LENGTH = "1 day"
GRACE = "1 hour"
WATERMARK_DELAY = "2 days"


def windowed_uploads(uploads: DataFrame) -> DataFrame:
    win = F.window("ts", ROUND_LENGTH)
    w = uploads.withWatermark("ts", WATERMARK_DELAY).select("*", win.alias("win"))
    on_time = F.col("arrival_ts") <= F.col("win.end") + F.expr(f"interval {GRACE}")
    return (w.filter(on_time).groupBy("win")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("w").cast("long").alias("sum_w"),
                 F.sum(F.col("w") * F.col("v")).alias("sum_wv")))


def run_round_average(spark: SparkSession, src: str, sink: str, ckpt: str, schema, files_per_trigger: int = 1) -> None:
    """Process every file now in ``src`` (``availableNow``), resuming from ``ckpt``.
    Each micro-batch's updated windows go to ``sink/batch_id=N`` (overwrite: a
    replayed batch after a failure rewrites the same folder)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("win.start").alias("win_start"), "n", "sum_w", "sum_wv")
         .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}"))

    q = (windowed_uploads(stream).writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def read_round_average(spark: SparkSession, sink: str) -> DataFrame:
    """Latest row per window across all micro-batches."""
    out = spark.read.parquet(sink)
    latest = Window.partitionBy("win_start").orderBy(F.col("batch_id").desc())
    final = out.withColumn("_k", F.row_number().over(latest)).filter(F.col("_k") == 1)
    return final.select(F.date_format("win_start", "yyyy-MM-dd HH:mm:ss").alias("round_start"), "n", "sum_w",
                        "sum_wv", (F.col("sum_wv") / F.col("sum_w")).alias("avg_v"))


def stream_round_average(spark: SparkSession, src: str, base: str, files_per_trigger: int = 16) -> DataFrame:
    """Averages of the uploads under ``src``, whose files are in arrival order; sink and state under ``base``."""
    sink, ckpt = f"{base}/sink", f"{base}/checkpoint"
    run_round_average(spark, src, sink, ckpt, spark.read.parquet(src).schema, files_per_trigger)
    return read_round_average(spark, sink)


# ------------------------------------------------------------------ whole parameter states

def _on_time(uploads: DataFrame) -> DataFrame:
    """Uploads before their round's deadline, with their round ``win``; the watermark bounds the state."""
    timed = uploads.withWatermark("ts", WATERMARK_DELAY).select("*", F.window("ts", ROUND_LENGTH).alias("win"))
    return timed.filter(F.col("arrival_ts") <= F.col("win.end") + F.expr(f"interval {GRACE}"))


def window_weights(uploads: DataFrame) -> DataFrame:
    """Clients and samples of every round: each client counts once a round, however many tensors it sends.

    Two aggregations one after the other: per (round, client), then per round.
    """
    clients = _on_time(uploads).groupBy("win", "client_id").agg(F.max("n_samples").alias("n"))
    per_round = F.window(F.window_time("win"), ROUND_LENGTH).alias("win")
    return (clients.groupBy(per_round).agg(F.count("client_id").alias("n_clients"), F.sum("n").alias("n_samples"))
            .select(F.col("win.start").alias("round_start"), "n_clients", "n_samples"))


def window_blocks(uploads: DataFrame) -> DataFrame:
    """Sums of samples times value of every round and tile, place by place."""
    sums = [F.sum(F.col("n_samples") * F.get("v", F.lit(o))).alias(f"_v{o}") for o in range(WIDTH)]
    return (_on_time(uploads).groupBy("win", *KEYS).agg(*sums)
            .select(F.col("win.start").alias("round_start"), *KEYS, F.array(*[f"_v{o}" for o in range(WIDTH)]).alias("v")))


def run_state_average(spark: SparkSession, src: str, base: str, files_per_trigger: int = 16) -> None:
    """Process every upload now in ``src`` (``availableNow``), resuming from the checkpoints under ``base``.

    ``src``: parquet files in arrival order of ``(ts, arrival_ts, client_id, n_samples, param_id, k, t, v)``. A round is
    written once, when the watermark has passed it: any later upload, also one without tensors, closes it.
    """
    stream = (spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src))
    running = [made(stream).writeStream.format("parquet").outputMode("append")
               .option("checkpointLocation", f"{base}/{name}-checkpoint").trigger(availableNow=True).start(f"{base}/{name}")
               for name, made in (("weights", window_weights), ("blocks", window_blocks))]
    for q in running:
        q.awaitTermination()


def read_state_average(spark: SparkSession, base: str) -> DataFrame:
    """The closed rounds' averaged states ``(round_start, n_clients, param_id, k, t, v)``: #24 with late uploads left out."""
    weights = spark.read.parquet(f"{base}/weights")
    out = spark.read.parquet(f"{base}/blocks").where("param_id is not null").join(weights, "round_start")
    return out.select("round_start", "n_clients", *KEYS, F.transform("v", lambda x: x / F.col("n_samples")).alias("v"))
