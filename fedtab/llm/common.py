"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedtab.session import materialize, release

#: A word: a run of anything but ASCII white space (same text in Java and RE2).
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """Array of the words of a text; a null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A draw in [0, 1) that depends on the key and the seed alone (52 bits of md5)."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of so many rows, so that what is made of one is small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def ranked(df: DataFrame, order_col: str, rank_col: str) -> DataFrame:
    """Add the 0-based rank by ``order_col`` (unique values, null last) without one sorting task.

    Range partitions are sorted each on its own; a table of one row per
    partition says how many rows come before it.
    """
    by = F.col(order_col).asc_nulls_last()
    dealt = materialize(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return (dealt.withColumn("_local", local).join(starts, "_part")
            .withColumn(rank_col, (F.col("_start") + F.col("_local")).cast("long"))
            .drop("_part", "_local", "_start"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component_id)`` for every node of an undirected edge table; the id is the least node.

    Alternating star contraction: every node hangs its larger neighbours on its
    least one, then its smaller neighbours likewise, until nothing moves. Each
    round's edges are written to the shared folder, so a lost executor replays
    one round and a hub's edges are read by many tasks; the per-node minimum is
    read back from its own table, which lets AQE split a hub in the join.
    Null ends and self-loops are ignored; an empty table gives an empty one.
    """
    links = (edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    links = materialize(links, "links")
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                          .select("u", F.least("u", "m").alias("m")), "low")
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        large = materialize(large, "large")
        release(links, low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        links = materialize(small, "links")
        release(large, low)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = links.select(F.col("v").alias("node")).distinct()
    return (links.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
            .union(roots.select("node", F.col("node").alias("component_id"))))
