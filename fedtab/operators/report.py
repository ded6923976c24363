"""Run analytics (#31, #34-#41): the tables behind the reference's charts and report tables.

Inputs are run-level tables (one row per method x alpha x round); a window here
holds the rows of one run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fedtab.functions.params import METHODS
from fedtab.operators.positions import running_max

RUN = ("method", "alpha")


def run_summary(rounds: DataFrame) -> DataFrame:
    """#31: final = last evaluated round, best = max over rounds, total comm, mean bias.
    A run with no evaluated round has no row (trap T17)."""
    return rounds.groupBy(*RUN).agg(
        F.max_by("acc", "round").alias("final_acc"),
        F.max_by("f1", "round").alias("final_f1"),
        F.max_by("loss", "round").alias("final_loss"),
        F.max("acc").alias("best_acc"),
        F.max("f1").alias("best_f1"),
        F.sum("comm_mb").alias("total_comm_mb"),
        F.avg("bias").alias("mean_bias"),
    )


def accuracy_matrix(final: DataFrame, methods: Sequence[str] = METHODS, value: str = "final_acc") -> DataFrame:
    """#34: final accuracy by alpha (rows, descending) x method (columns)."""
    return (final.groupBy("alpha").pivot("method", list(methods)).agg(F.first(value))
            .orderBy(F.col("alpha").desc()))


def efficiency_frontier(final: DataFrame, cost: str = "total_comm_mb", gain: str = "final_acc") -> DataFrame:
    """#35: flag runs no other run beats (cost <= and gain >=, one strictly).

    Per distinct cost: the best gain; a running max over strictly cheaper costs, taken
    in sorted pieces, so no task holds all runs; a row is dominated if a cheaper run
    reaches its gain or an equal-cost run exceeds it. No self-join.
    """
    by_cost = running_max(final.groupBy(cost).agg(F.max(gain).alias("_gmax")), cost, "_gmax", "_before")
    j = final.join(by_cost, cost)
    dominated = (F.coalesce(F.col("_before") >= F.col(gain), F.lit(False))) | (F.col("_gmax") > F.col(gain))
    return j.withColumn("on_frontier", ~dominated).drop("_gmax", "_before")


def convergence_curves(rounds: DataFrame, metric: str = "acc") -> DataFrame:
    """#36: metric series per (alpha, method) by round, with the change from the previous round."""
    w = Window.partitionBy(*RUN).orderBy("round")
    return rounds.select("alpha", "method", "round", metric,
                         (F.col(metric) - F.lag(metric).over(w)).alias(f"delta_{metric}"))


def comm_totals(rounds: DataFrame, ref_alpha: float) -> DataFrame:
    """#37: total communication per method at the reference alpha."""
    return (rounds.filter(F.col("alpha") == F.lit(ref_alpha))
            .groupBy("method").agg(F.sum("comm_mb").alias("total_comm_mb")))


def bias_curves(rounds: DataFrame, ref_alpha: float) -> DataFrame:
    """#38: bias per method by round at the reference alpha."""
    return rounds.filter(F.col("alpha") == F.lit(ref_alpha)).select("method", "round", "bias")


def comm_saving(rounds: DataFrame, baseline: str = "standard_lora") -> DataFrame:
    """#39: saving in % against the baseline method at the same alpha; mean MB per round."""
    tot = rounds.groupBy(*RUN).agg(F.sum("comm_mb").alias("total_comm_mb"),
                                   F.avg("comm_mb").alias("mean_round_mb"))
    base = tot.filter(F.col("method") == baseline).select("alpha", F.col("total_comm_mb").alias("_base"))
    return (tot.join(base, "alpha", "left")
            .withColumn("saving_pct", F.lit(100.0) * (F.lit(1.0) - F.col("total_comm_mb") / F.col("_base")))
            .drop("_base"))


def successful_uploads(rounds: DataFrame, uploads: DataFrame) -> DataFrame:
    """Clients whose update arrived, per round: ``(method, alpha, round, n_uploads)``.

    ``uploads`` = (method, alpha, round, client_id), one row or more per update that arrived. The evaluated rounds
    are the spine, so a round that every client dropped out of counts 0; uploads of other rounds are left out.
    """
    keys = [*RUN, "round"]
    counted = uploads.groupBy(*keys).agg(F.countDistinct("client_id").alias("n_uploads"))
    return (rounds.select(*keys).distinct().join(counted, keys, "left")
            .select(*keys, F.coalesce("n_uploads", F.lit(0)).cast("long").alias("n_uploads")))


def degradation_report(rounds: DataFrame, uploads: DataFrame) -> DataFrame:
    """#40: per method, final accuracy at the highest alpha minus at the lowest (points), sample std-dev of
    accuracy over rounds at the lowest alpha, rounds evaluated, and the successful uploads of these rounds
    (all of them, the fewest in a round, and rounds without any)."""
    final = run_summary(rounds)
    per_method = final.groupBy("method").agg(
        F.max_by("final_acc", "alpha").alias("acc_high_alpha"),
        F.min_by("final_acc", "alpha").alias("acc_low_alpha"),
        F.min("alpha").alias("alpha"))
    arrived = successful_uploads(rounds, uploads)
    low = (rounds.join(per_method.select(*RUN), list(RUN), "left_semi").join(arrived, [*RUN, "round"])
           .groupBy("method").agg(F.stddev_samp("acc").alias("acc_std_low_alpha"), F.count(F.lit(1)).alias("n_rounds_low_alpha"),
                                  F.sum("n_uploads").alias("n_uploads"), F.min("n_uploads").alias("min_uploads"),
                                  F.sum((F.col("n_uploads") == 0).cast("int")).alias("n_rounds_without")))
    return per_method.join(low, "method").select(
        "method", (F.lit(100.0) * (F.col("acc_low_alpha") - F.col("acc_high_alpha"))).alias("degradation_pts"),
        "acc_std_low_alpha", "n_rounds_low_alpha", "n_uploads", "min_uploads", "n_rounds_without")


def run_comparison(final_a: DataFrame, final_b: DataFrame, keys: Sequence[str] = ("method",),
                   value: str = "final_acc") -> DataFrame:
    """#41: the same method under two configurations, side by side."""
    a = final_a.select(*keys, F.col(value).alias(f"{value}_a"))
    b = final_b.select(*keys, F.col(value).alias(f"{value}_b"))
    return a.join(b, list(keys), "inner").withColumn("diff", F.col(f"{value}_b") - F.col(f"{value}_a"))
