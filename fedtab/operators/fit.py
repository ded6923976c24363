"""Local training work (#44-#46), re-aimed at Spark.

Model: softmax over logits = H x with H (C x d) the head. Every client trains at
once: a full-batch step is one aggregation of the gradient over all rows, so a
client of any size is spread over all tasks. Rows never leave their tasks; a step
moves one C x d gradient per client and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedtab.operators.state import CELL_KEYS
from fedtab.session import materialize

LEARNING_RATE = 0.5
STEPS = 2
SALTS = 256


def proximal_penalty(local: DataFrame, global_: DataFrame, mu: float, group_cols: Sequence[str] = ("client_id",)
                     ) -> DataFrame:
    """#44: (mu/2) * sum (theta - theta_global)^2 over local parameters whose name is in
    the global state; cells the global lacks count as 0 (trap T6). Also a drift metric."""
    keys = global_.select("param").distinct()
    loc = local.join(keys, "param", "left_semi")
    j = loc.join(global_.select(*CELL_KEYS, F.col("v").alias("_g")), list(CELL_KEYS), "left")
    d = F.col("v") - F.coalesce(F.col("_g"), F.lit(0.0))
    return j.groupBy(*group_cols).agg((F.lit(mu / 2) * F.sum(d * d)).alias("penalty"))


def local_gradient(features: DataFrame, num_classes: int) -> DataFrame:
    """#45: gradient of the mean cross-entropy at W = 0 (p = 1/C), per client:
    grad[c, j] = (sum_rows x_j / C - sum_{rows with y = c} x_j) / n.

    One aggregation over exploded (client, y, j) values; the C classes are added
    on the aggregated (client, j) table, never by multiplying the rows.
    """
    ex = features.select("client_id", "y", F.posexplode("x").alias("j", "xj"))
    by_class = ex.groupBy("client_id", "y", "j").agg(F.sum("xj").alias("t"))
    n = features.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    tot = by_class.groupBy("client_id", "j").agg(F.sum("t").alias("s"))
    grid = tot.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1))))
    out = (grid.join(by_class.withColumnRenamed("y", "class"), ["client_id", "class", "j"], "left")
           .join(n, "client_id"))
    g = (F.col("s") / F.lit(float(num_classes)) - F.coalesce(F.col("t"), F.lit(0.0))) / F.col("n")
    return out.select("client_id", F.col("class").cast("int").alias("class"), F.col("j").cast("int").alias("j"),
                      g.alias("grad"))


def _logits(x: Column, w: Column) -> Column:
    """H x for a row and its client's head, an array of one row per class."""
    return F.transform(w, lambda h: F.aggregate(F.zip_with(x, h, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def _scored(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows with their client's head applied: class probabilities and cross-entropy.

    ``heads`` has one row per client; AQE broadcasts it by its bytes, or splits a hot client.
    """
    z = rows.join(heads, "client_id").withColumn("z", _logits(F.col("x"), F.col("w")))
    m = F.array_max("z")
    z = z.withColumn("e", F.transform("z", lambda v: F.exp(v - m))).withColumn("m", m)
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    z = z.withColumn("t", total)
    return z.select("client_id", "y", "x", F.transform("e", lambda v: v / F.col("t")).alias("p"),
                    (F.col("m") + F.log("t") - F.get("z", F.col("y"))).alias("loss"))


def _stepped(rows: DataFrame, heads: DataFrame, mu: float, rate: float) -> DataFrame:
    """One full-batch step of every client: mean gradient plus the pull to the start (#44), which is 0.

    A row's gradient is one vector; the JVM adds them place by place, combined before the shuffle.
    """
    off = F.transform("p", lambda v, c: v - F.when(c == F.col("y"), 1.0).otherwise(0.0))
    flat = F.flatten(F.transform(off, lambda r: F.transform("x", lambda v: r * v)))
    grads = (_scored(rows, heads).select("client_id", array_to_vector(flat).alias("v")).groupBy("client_id")
             .agg(Summarizer.metrics("mean").summary(F.col("v")).alias("g"))
             .select("client_id", vector_to_array(F.col("g.mean")).alias("g")))
    step = F.transform("w", lambda h, c: F.transform(h, lambda v, j: v - F.lit(rate) * (
        F.get("g", (c * F.size(h) + j).cast("int")) + F.lit(mu) * v)))
    return heads.join(grads, "client_id").select("client_id", step.alias("w"))


def local_fit(features: DataFrame, num_classes: int, dim: int, steps: int = STEPS, mu: float = 0.01,
              rate: float = LEARNING_RATE) -> DataFrame:
    """#46: ``steps`` full-batch steps of every client from a zero head.

    ``(client_id, w)``: one head per client. Heads are written after each step, so a
    lost executor replays one step.
    """
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), dim), num_classes)
    heads = features.select("client_id").distinct().withColumn("w", zero)
    for _ in range(steps):
        heads = materialize(_stepped(features, heads, mu, rate), "heads")
    return heads


def local_fit_summary(features: DataFrame, num_classes: int, dim: int, steps: int = STEPS, mu: float = 0.01,
                      rate: float = LEARNING_RATE) -> DataFrame:
    """Per client its rows, the loss before and after the steps and the squared norm of its head."""
    heads = local_fit(features, num_classes, dim, steps, mu, rate)
    norm = F.aggregate(F.flatten("w"), F.lit(0.0), lambda s, v: s + v * v)
    last = _scored(features, heads).groupBy("client_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("loss").alias("last_loss"))
    return (last.join(heads.select("client_id", norm.alias("norm2")), "client_id")
            .withColumn("first_loss", F.log(F.lit(float(num_classes)))))


def score_with_heads(rows: DataFrame, heads: DataFrame, keys: Sequence[str], models_per_chunk: int = 64) -> DataFrame:
    """Logits of every row under each head: ``heads`` has ``(keys..., w)``, any number of models.

    Models are dealt by a hash of their keys into chunks of about ``models_per_chunk``, each chunk an array; every row
    meets every chunk once. Chunks join on (salt, chunk), so that neither a task nor the driver holds all models:
    AQE broadcasts the table if it is small, or else deals rows and chunks out by salt.
    """
    n_chunks = heads.agg((F.floor(F.count(F.lit(1)) / models_per_chunk) + 1).cast("int").alias("n")).scalar()
    packed = (heads.withColumn("_chunk", F.pmod(F.xxhash64(*keys), n_chunks).cast("int"))
              .groupBy("_chunk").agg(F.collect_list(F.struct(*keys, "w")).alias("_models"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    met = (rows.withColumn("_salt", F.pmod(F.hash("example_id"), F.lit(SALTS)))
           .withColumn("_chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1))))
    out = met.join(packed, ["_salt", "_chunk"]).withColumn("_m", F.explode("_models")).drop("_models", "_salt", "_chunk")
    return out.select("*", *[F.col(f"_m.{k}").alias(k) for k in keys], _logits(F.col("x"), F.col("_m.w")).alias("logits")).drop("_m")
