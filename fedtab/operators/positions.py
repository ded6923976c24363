"""Exact positions and carry-forward without sorting a whole group in one task.

Both helpers split each group into *buckets*, ranges of the ordering key that
are bounded in size, and run the window per (group, bucket). A small table of
per-bucket counts (or last values) gives every bucket what comes before it.
The helpers are used wherever a group may be huge: one class holding a third
of all rows (#15), one client (#16, fixtures), one log file (#3). Offsets are
joined on (group, bucket), the key the window already partitioned the rows by,
so the only extra data moved is the small offsets table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedtab.session import materialize

DEFAULT_BUCKET_WIDTH = 1 << 20


def int_bucket(col: str | Column, width: int = DEFAULT_BUCKET_WIDTH) -> Column:
    """Bucket for an integral ordering key: at most ``width`` distinct keys per bucket."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width)).cast("long")


def range_positions(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], pos_col: str = "pos") -> DataFrame:
    """Add ``pos`` = 0-based rank of each row within its group by ``order``, for any ordering key.

    The table is dealt out by ranges of (group, order), so the number of pieces
    follows the number of shuffle partitions; each piece is numbered by itself and
    a table of one row per (group, piece) says what comes before. The dealt table is
    written once: a retried task cannot draw other ranges. ``order`` must be unique
    within a group.
    """
    g = list(group_cols)
    dealt = materialize(df.repartitionByRange(*g, *order).withColumn("_piece", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(*g, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*g).orderBy("_piece") if g else Window.orderBy("_piece")
    offsets = counts.select(*g, "_piece", F.coalesce(
        F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(*g, "_piece").orderBy(*order)) - 1)
    out = local.join(offsets, on=[*g, "_piece"], how="inner")
    return out.withColumn(pos_col, (F.col("_off") + F.col("_rn")).cast("long")).drop("_piece", "_rn", "_off")


def running_max(df: DataFrame, order: str, value: str, out_col: str) -> DataFrame:
    """Add the largest ``value`` among the rows before each one by ``order`` (null for the first).

    The table is dealt out by ranges of ``order``; each piece has its own running maximum, and a table of one row
    per piece carries the maximum of the pieces before it. ``order`` must be unique and not null.
    """
    dealt = materialize(df.repartitionByRange(order).withColumn("_piece", F.spark_partition_id()), "dealt")
    most = dealt.groupBy("_piece").agg(F.max(value).alias("_most"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = most.select("_piece", F.max("_most").over(before).alias("_carry"))
    within = Window.partitionBy("_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.max(value).over(within))
    return own.join(carry, "_piece").withColumn(out_col, F.greatest("_own", "_carry")).drop("_piece", "_own", "_carry")


def group_positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                    bucket: Column, pos_col: str = "pos") -> DataFrame:
    """Add ``pos`` = 0-based rank of each row within its group by ``order_cols``.

    ``order_cols`` must be unique within a group and ``bucket`` must be monotone
    in them. The window runs per (group, bucket); the offsets table has one row
    per (group, bucket). It joins on (group, bucket), the key the window already
    partitioned the rows by, so only the offsets move; AQE broadcasts them if
    they are small.
    """
    group_cols = list(group_cols)
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*group_cols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w_before = Window.partitionBy(*group_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group_cols, "_bkt",
                            F.coalesce(F.sum("_n").over(w_before), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(*group_cols, "_bkt").orderBy(*order_cols)
    local = b.withColumn("_rn", F.row_number().over(w_in))
    out = local.join(offsets, on=[*group_cols, "_bkt"], how="inner")
    return out.withColumn(pos_col, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_bkt", "_rn", "_off")


def carry_forward(df: DataFrame, partition_cols: Sequence[str], order_col: str,
                  values: dict[str, Column], counters: dict[str, Column] | None = None,
                  width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """Last non-null value of each expression up to the current row (``values``) and
    running counts of true flags (``counters``), ordered by an integral ``order_col``
    within ``partition_cols``. Exact for any partition size: the scan runs per
    bucket of ``width`` keys and a per-bucket summary carries state across buckets.
    """
    counters = counters or {}
    partition_cols = list(partition_cols)
    b = df.withColumn("_bkt", int_bucket(order_col, width))
    for name, expr in values.items():
        b = b.withColumn(f"_v_{name}", expr)
    for name, expr in counters.items():
        b = b.withColumn(f"_c_{name}", expr.cast("int"))

    w_local = (Window.partitionBy(*partition_cols, "_bkt").orderBy(order_col)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for name in values:
        b = b.withColumn(f"_l_{name}", F.last(f"_v_{name}", ignorenulls=True).over(w_local))
    for name in counters:
        b = b.withColumn(f"_lc_{name}", F.sum(f"_c_{name}").over(w_local))

    # per-bucket summary: last non-null value in the bucket and the bucket's count
    aggs = [F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(order_col))).alias(f"_s_{n}")
            for n in values]
    aggs += [F.sum(f"_c_{n}").alias(f"_sc_{n}") for n in counters]
    summary = b.groupBy(*partition_cols, "_bkt").agg(*aggs) if aggs else None
    if summary is None:
        return df
    w_prev = Window.partitionBy(*partition_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *partition_cols, "_bkt",
        *[F.last(f"_s_{n}", ignorenulls=True).over(w_prev).alias(f"_in_{n}") for n in values],
        *[F.coalesce(F.sum(f"_sc_{n}").over(w_prev), F.lit(0)).alias(f"_inc_{n}") for n in counters],
    )
    # one summary row per (partition, bucket). Many small logs make this table large,
    # so it is joined on (partition, bucket), the key the local window already
    # partitioned the rows by; AQE turns it into a broadcast when it is small.
    out = b.join(carry, on=[*partition_cols, "_bkt"], how="inner")
    for n in values:
        out = out.withColumn(n, F.coalesce(F.col(f"_l_{n}"), F.col(f"_in_{n}")))
    for n in counters:
        out = out.withColumn(n, (F.coalesce(F.col(f"_lc_{n}"), F.lit(0)) + F.col(f"_inc_{n}")).cast("long"))
    drop = ["_bkt"] + [c for c in out.columns if c.startswith(("_v_", "_c_", "_l_", "_lc_", "_in_", "_inc_"))]
    return out.drop(*drop)
