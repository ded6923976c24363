import pytest
from pyspark.sql import functions as F

from fedtab.llm.mixing import emit_mix, mix_sources, source_targets


def brute(sizes, weights=(3, 1, 2), epochs=1.5, most=2.0):
    """Excess reshared by weight until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, stopped, left = {}, set(), epochs * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in stopped]
        total = sum(w[s] for s in rest)
        share = {s: left * w[s] / total for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            stopped.add(s)


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, "c": 50, None: 5}, {"a": 1, "b": 1000, "c": 1, "d": 1, "é": 3}, {"x": 7}, {"a": 0, "b": 9}])
def test_targets_are_the_reshared_ones(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    out = {r.source: r.target for r in source_targets(rows).collect()}
    want = brute(sizes)
    assert set(out) == set(want) and all(abs(out[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_mix_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x", None), (3, None, "s"), (4, "", "t"), (5, "q " * 5000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string") \
        .withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash"))
    out = mix_sources(docs).collect()
    assert len(out) == 6 and sorted(r["size"] for r in out) == [0, 0, 1, 3, 3, 5000]
    assert all(0 <= r.copies <= 2 for r in out)
    twins = [r.copies for r in out if r.doc_id == 1]
    assert twins[0] == twins[1]
    emitted = emit_mix(docs)
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(r.copies for r in out)


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + id % 40)").alias("text"),
                                     F.expr("case when id % 3 = 0 then 'big' else 's' || id % 5 end").alias("source"))
    out = mix_sources(docs)
    per = out.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.expr("size * copies")).alias("n")).collect()
    assert all(abs(r.n - r.t) < 0.05 * r.t for r in per)
    same = out.select("doc_id", "copies").exceptAll(mix_sources(docs.repartition(7)).select("doc_id", "copies"))
    assert same.count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(docs).collect() == [] and emit_mix(docs).collect() == []


def test_one_key_for_a_third_of_the_rows_meets_the_targets(spark):
    """Rows of one key, or of none, are drawn one by one: their texts tell them apart."""
    for hot in (7, None):
        rows = [(hot if i % 3 == 0 else 10_000 + i, f"s{i % 9 // 3}", f"w{i} " * (5 + i % 7)) for i in range(9000)]
        out = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"))
        for r in out.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.expr("size * copies")).alias("n")).collect():
            assert abs(r.n / r.t - 1) < 0.05
