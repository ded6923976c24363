"""Partitioning and sampling of entities and rows (#12-#18, #22, #43, #14)."""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedtab.functions.hashing import bernoulli, seeded_digest
from fedtab.operators.positions import group_positions, int_bucket, range_positions


def hash_bernoulli_drop(df: DataFrame, key_cols: Sequence[str], p: float, seed: int = 42) -> DataFrame:
    """#12: drop each row with probability ``p``, decided by md5(seed:key...).

    Re-run safe and independent of partitioning; a pure filter, so it runs
    map-side with no shuffle.
    """
    return df.filter(~bernoulli(seed, p, *key_cols))


def cohort_sample(df: DataFrame, round_col: str, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """#13: choose ``k`` of the candidates of each round without replacement.

    Order = md5(seed:round:id); ``row_number() <= k`` is planned as a
    WindowGroupLimit, so each map task keeps at most k rows per round before the
    shuffle: a round with a third of all candidates still moves only k rows per task.
    """
    key = seeded_digest(seed, round_col, id_col)
    w = Window.partitionBy(round_col).orderBy(key, F.col(id_col))
    return (df.withColumn("pick", F.row_number().over(w))
            .filter(F.col("pick") <= k))


def _uniform(seed: int, *parts: str | Column) -> Column:
    """A draw in (0, 1) from the first 13 hex digits of md5(seed:part...)."""
    h = F.conv(F.substring(seeded_digest(seed, *parts), 1, 13), 16, 10).cast("long")
    return (h + F.lit(0.5)) / F.lit(float(1 << 52))


#: Attempts of the gamma draw; all are refused about once in 10^10 draws, and then it is its mode.
ATTEMPTS = 8


def gamma_draw(alpha: float, seed: int, *key: str) -> Column:
    """A gamma(alpha) draw that depends on the key alone, as one column expression.

    Marsaglia and Tsang's method with a fixed number of attempts, each with its own
    md5-seeded normal (Box-Muller) and uniform; below alpha 1 the draw for
    alpha + 1 is scaled by u ** (1 / alpha).
    """
    d = (alpha if alpha >= 1 else alpha + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    found = []
    for k in range(ATTEMPTS):
        u1, u2, u3 = (_uniform(seed, F.lit(f"{k}{x}"), *key) for x in "abc")
        x = F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
        t = 1.0 + F.lit(c) * x
        v = t * t * t
        ok = (v > 0) & (F.log(u3) < 0.5 * x * x + F.lit(d) - F.lit(d) * v + F.lit(d) * F.log(F.when(v > 0, v)))
        found.append(F.when(ok, F.lit(d) * v))
    g = F.coalesce(*found, F.lit(d))
    return g if alpha >= 1 else g * F.pow(_uniform(seed, F.lit("boost"), *key), F.lit(1 / alpha))


def dirichlet_proportions(classes: DataFrame, label_col: str, num_clients: int, alpha: float,
                          seed: int = 42) -> DataFrame:
    """#14: per class, a symmetric Dirichlet(alpha) draw over clients.

    Classes come from the data; the (class, client) table is classes x clients
    numbers. Each gamma draw depends on (seed, class, client), so the result does
    not depend on how Spark splits the table; normalisation is a window per class.
    """
    g = (classes.select(F.col(label_col).cast("int").alias("label")).distinct()
         .withColumn("client_id", F.explode(F.sequence(F.lit(0), F.lit(num_clients - 1))))
         .withColumn("g", gamma_draw(alpha, seed, "label", "client_id")))
    w = Window.partitionBy("label")
    return g.select("label", F.col("client_id").cast("int").alias("client_id"), (F.col("g") / F.sum("g").over(w)).alias("p"))


def hash_split(examples: DataFrame, proportions: DataFrame, weight_col: str = "p", seed: int = 42,
               id_col: str = "example_id", label_col: str = "label") -> DataFrame:
    """#15, hash mode: each row goes to the client in whose cumulative share its hash falls.

    No positions and no shuffle of the rows: a class's boundaries are one small
    array that joins on the class. Block sizes are as near to the shares as draws are.
    """
    bnd = cumulative_boundaries(proportions, weight_col)
    steps = bnd.groupBy("label").agg(F.array_sort(F.collect_list(
        F.struct((F.col("hi") / F.col("total")).alias("hi"), "client_id"))).alias("steps"), F.max("client_id").alias("last"))
    ex = examples.select(F.col(id_col).alias("example_id"), F.col(label_col).alias("label"),
                         _uniform(seed, F.lit("split"), id_col).alias("u"))
    hit = F.filter("steps", lambda s: F.col("u") < s["hi"])
    return ex.join(steps, "label").select("example_id", "label",
                                          F.coalesce(F.get(hit, F.lit(0))["client_id"], F.col("last")).alias("client_id"))


def cumulative_boundaries(proportions: DataFrame, weight_col: str = "p") -> DataFrame:
    """#43: per class, [lo, hi) of each client on the cumulative weight scale."""
    w = Window.partitionBy("label").orderBy("client_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return proportions.select(
        "label", "client_id", F.col(weight_col).alias("w"),
        F.sum(weight_col).over(w).alias("hi"),
        F.sum(weight_col).over(Window.partitionBy("label")).alias("total"),
    ).withColumn("lo", F.col("hi") - F.col("w"))


def proportional_split(examples: DataFrame, proportions: DataFrame, weight_col: str = "p",
                       id_col: str = "example_id", label_col: str = "label") -> DataFrame:
    """#15 / #18: cut each class's rows, in id order, into contiguous blocks.

    Client c of class y gets positions [floor(lo*n/total), floor(hi*n/total));
    the last client's hi equals total, so every row is assigned exactly once.
    Positions are exact and distributed (``group_positions``): no class is sorted
    in a single task.

    The range join is bucketed: positions of class y fall in buckets of width
    ceil(n_y / K) and each client block is listed once per bucket it overlaps
    (about 2K rows per class), so a row checks about two candidate blocks instead
    of all K. AQE broadcasts that table by its bytes, or splits a hot class.
    """
    ex = examples.select(F.col(id_col).alias("example_id"), F.col(label_col).alias("label"))
    pos = group_positions(ex, ["label"], ["example_id"], bucket=int_bucket("example_id"), pos_col="rn")
    n_per_class = ex.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    bnd = cumulative_boundaries(proportions, weight_col).join(n_per_class, "label")
    integral = isinstance(proportions.schema[weight_col].dataType,
                          (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    if integral:
        lo = F.expr("(lo * n) div total")
        hi = F.expr("(hi * n) div total")
    else:
        lo = F.floor(F.col("lo") * F.col("n") / F.col("total"))
        hi = F.floor(F.col("hi") * F.col("n") / F.col("total"))
    per_class = Window.partitionBy("label")
    last = F.col("client_id") == F.max("client_id").over(per_class)
    width = F.greatest(F.lit(1), F.ceil(F.col("n") / F.count(F.lit(1)).over(per_class))).cast("long")
    bnd = bnd.select("label", "client_id", lo.cast("long").alias("lo_pos"),
                     F.when(last, F.col("n")).otherwise(hi).cast("long").alias("hi_pos"), width.alias("width"))
    # empty blocks own no rows; every other block is listed under each bucket it spans
    spans = (bnd.filter(F.col("hi_pos") > F.col("lo_pos"))
             .withColumn("bkt", F.explode(F.sequence(F.expr("lo_pos div width"), F.expr("(hi_pos - 1) div width")))))
    widths = bnd.select("label", "width").distinct()
    rows = pos.join(widths, "label").withColumn("bkt", F.expr("rn div width"))
    j = rows.join(spans.select("label", "bkt", "client_id", "lo_pos", "hi_pos"),
                  on=["label", "bkt"], how="inner").filter((F.col("rn") >= F.col("lo_pos")) & (F.col("rn") < F.col("hi_pos")))
    return j.select("example_id", "label", "client_id")


def shuffle_within_group(df: DataFrame, group_col: str, id_col: str, seed: int = 42) -> DataFrame:
    """#16: seeded permutation of each group's rows, as 0-based ``pos``."""
    d = df.withColumn("_key", seeded_digest(seed, id_col))
    return range_positions(d, [group_col], [F.col("_key"), F.col(id_col)]).drop("_key")


def cap_per_group(df: DataFrame, group_col: str, id_col: str, cap: int, seed: int = 42) -> DataFrame:
    """#17: the first ``cap`` rows of each group in its seeded shuffled order.

    ``row_number() <= cap`` becomes a WindowGroupLimit: a partial limit runs
    before the shuffle, so a huge group moves at most ``cap`` rows per map task.
    """
    key = seeded_digest(seed, id_col)
    w = Window.partitionBy(group_col).orderBy(key, F.col(id_col))
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= cap).drop("_rk")


def label_distribution(assignment: DataFrame, clients: DataFrame, labels: Sequence[int],
                       names: Sequence[str], client_col: str = "client_id",
                       label_col: str = "label") -> DataFrame:
    """#22: count of each label per client, wide, zero-filled, every client present.

    Pivot values are explicit (no extra job, stable schema); the pivot is one
    partial+final aggregation. ``clients`` is the client spine.
    """
    counts = assignment.groupBy(client_col).pivot(label_col, list(labels)).agg(F.count(F.lit(1)))
    counts = counts.select(client_col, *[F.col(str(v)).alias(nm) for v, nm in zip(labels, names)])
    spine = clients.select(client_col).distinct()
    out = spine.join(counts, client_col, "left")
    return out.select(client_col, *[F.coalesce(F.col(f"`{nm}`"), F.lit(0)).cast("long").alias(nm) for nm in names])
