"""Scoring (#32, #33): per-row argmax and cross-entropy, then accuracy and macro-F1.

Per-row work is array expressions (``array_max``, ``transform``, ``aggregate``)
inside codegen; the metrics are a confusion-count aggregation of at most
C x C rows, computed with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_argmax_loss(pred: DataFrame, logits_col: str = "logits", label_col: str = "label") -> DataFrame:
    """#32: pred = first position of the max logit; loss = logsumexp(logits) - logits[label]."""
    lg = F.col(logits_col)
    m = F.array_max(lg)
    sum_exp = F.aggregate(F.transform(lg, lambda x: F.exp(x - m)), F.lit(0.0), lambda acc, x: acc + x)
    lse = m + F.log(sum_exp)
    return pred.withColumn("pred", (F.array_position(lg, m) - 1).cast("int")) \
               .withColumn("loss", lse - F.element_at(lg, F.col(label_col) + 1))


def classification_metrics(scored: DataFrame, group_cols: Sequence[str] = (), label_col: str = "label",
                           pred_col: str = "pred", loss_col: str | None = "loss") -> DataFrame:
    """#33: accuracy; macro-F1 over labels seen in truth or prediction (F1 = 0 on an
    empty denominator); mean loss. One confusion aggregation, then tiny tables."""
    g = list(group_cols)
    has_loss = loss_col is not None
    conf = scored.groupBy(*g, F.col(label_col).alias("t"), F.col(pred_col).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), *([F.sum(loss_col).alias("loss_sum")] if has_loss else []))
    # per class (<= C rows per group): support in truth, in prediction, true positives
    truth = conf.groupBy(*g, F.col("t").alias("cls")).agg(
        F.sum("n").alias("n_true"),
        F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))).alias("tp"),
        *([F.sum("loss_sum").alias("loss_sum")] if has_loss else []))
    predicted = conf.groupBy(*g, F.col("p").alias("cls")).agg(F.sum("n").alias("n_pred"))
    classes = truth.join(predicted, on=[*g, "cls"], how="full_outer")
    n_true = F.coalesce(F.col("n_true"), F.lit(0))
    tp = F.coalesce(F.col("tp"), F.lit(0))
    denom = n_true + F.coalesce(F.col("n_pred"), F.lit(0))
    f1 = F.when(denom > 0, 2.0 * tp / denom).otherwise(F.lit(0.0))
    out = classes.groupBy(*g).agg(
        F.sum(n_true).alias("n"), F.sum(tp).alias("n_correct"), F.avg(f1).alias("macro_f1"),
        F.count(F.lit(1)).alias("n_classes"), *([F.sum("loss_sum").alias("loss_sum")] if has_loss else []))
    cols = [*g, "n", (F.col("n_correct") / F.col("n")).alias("accuracy"), "macro_f1", "n_classes"]
    if has_loss:
        cols.append((F.col("loss_sum") / F.col("n")).alias("mean_loss"))
    return out.select(*cols)
