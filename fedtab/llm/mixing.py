"""Mixing sources to target weights.

Tokens are summed per source, each source's repetition rate is its target over
its size, and every document is emitted ``floor(rate)`` times plus one more time
with probability equal to the fraction, drawn from a hash of its key, source and text.

Only DataFrame functions run here. The corpus is read once for the sizes; what
follows works on ``(key, source, size)`` and on one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedtab.llm.common import n_words, ranked, uniform
from fedtab.session import materialize

#: Weights of the sources in order of name, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words, and no source more than this multiple of its own.
EPOCHS, MOST = 1.5, 2.0
SEED = "mix"


def _draw(key: str, source: str, text: Column, seed: str) -> Column:
    """A draw that rows of one key, or none, do not share unless their texts are the same, too."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return uniform(F.concat_ws(":", part(F.col(key)), part(F.col(source)), text), seed)


def source_targets(sized: DataFrame, source: str = "source", size: str = "size",
                   weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """``(source, source_size, weight, target)``, one row per source (null is a source, the last).

    Targets share ``epochs`` times all words by weight. A target above ``most``
    times its source stops there and the excess is shared again by weight: the
    level (words per unit of weight) rises until no further source stops. Each
    turn of that loop is one aggregation over the source table that returns two
    numbers. Sources without words get 0; an empty table gives an empty one.
    """
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    table = ranked(totals, "source", "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = materialize(table.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, None
    limit = F.col("source_size") * F.lit(float(most))
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        row = table.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))),
                        F.count(F.when(full, 1))).first()
        if row[2] == stopped or not row[1]:
            break
        stopped = row[2]
        level = (epochs * whole - most * (row[0] or 0)) / row[1]
    full = limit <= F.col("weight") * F.lit(level)
    return table.withColumn("target", F.when(full, limit).otherwise(F.col("weight") * F.lit(level)))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                seed: str = SEED, **shares) -> DataFrame:
    """``(key, source, size, source_size, target, rate, copies)`` for every document.

    A null or empty text has size 0. Rows of equal key, source and text take the
    same draw; a null key or source draws as the word ``null``. Copies of a document
    are the rate rounded down plus a draw against the fraction, so a source's
    words come near its target and no document is taken more than ``most`` times.
    """
    sized = materialize(docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                                    F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_text"), n_words(text).alias("size")), "sized")
    targets = source_targets(sized, **shares).withColumnRenamed("source", "_source")
    out = sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).drop("_source", "weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("rate", rate)
    whole = F.floor("rate")
    extra = (_draw("key", "source", F.col("_text"), seed) < F.col("rate") - whole).cast("long")
    return out.withColumn("copies", (whole + extra).cast("long")).drop("_text").withColumnRenamed("key", key)


def emit_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
             seed: str = SEED, **shares) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with its own columns.

    The rates need one row per source, so the texts are not moved: the source
    table joins to them (AQE broadcasts it by its bytes, or splits a hot source)
    and each row repeats itself. A document without words is emitted 0 or more
    times like any other of its source.
    """
    sized = docs.groupBy(F.col(source).alias("source")).agg(F.sum(n_words(text)).cast("long").alias("size"))
    targets = source_targets(materialize(sized, "sized"), **shares)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias("_source"), rate.alias("_rate"))
    drawn = docs.join(targets, docs[source].eqNullSafe(targets["_source"]))
    whole = F.floor("_rate").cast("int")
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    copies = whole + (_draw(key, source, digest, seed) < F.col("_rate") - whole).cast("int")
    return (drawn.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
            .drop("_source", "_rate", "_copy"))
