"""Large queries move vectors, tiles and chunks, not products, pairs, cells or words (F1-F4 of round 3)."""

import re

import pytest
from pyspark.sql import functions as F

from fedtab.operators import blocks, linalg, state
from fedtab.plans import round_report as report
from fedtab.sources import text

A, B, H = "m.0.lora_A.default.weight", "m.0.lora_B.default.weight", "m.0.score.weight"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_by(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(df))


def test_products_are_not_shuffled(spark):
    """equal cells add up, gaps and cells that only one side has; no output cell is shuffled."""
    rows = [(1, B, 0, 0, 2.0), (1, B, 0, 0, 3.0), (1, B, 1, 5, 7.0), (1, B, 2, 9, 1.0), (1, B, 3, 0, None),
            (1, A, 0, 0, 10.0), (1, A, 5, 0, 100.0), (1, A, 0, 1, 1.0), (None, A, 0, 0, 1.0), (None, B, 0, 0, 1.0)]
    rows += [(2, B, 0, k, float(k)) for k in range(20)] + [(2, A, k, 0, 2.0) for k in range(20)]
    cells = spark.createDataFrame(rows, "client_id int, param string, i int, j int, v double")
    out = linalg.matrix_product(cells)
    assert {(r["client_id"], r["i"], r["j"]): r["w"] for r in out.collect()} == {
        (1, 0, 0): 50.0, (1, 0, 1): 5.0, (1, 1, 0): 700.0, (1, 3, 0): None, (1, 3, 1): None, (2, 0, 0): 380.0}
    assert not [k for k in shuffled_by(out) if re.search(r"\bi#\d+L?, j#", k)]
    w = spark.createDataFrame([(1, 0.25), (2, 0.75)], "client_id int, weight double")
    mean = linalg.mean_product(cells, w, weighted=True)
    assert {(r["i"], r["j"]): r["w"] for r in mean.collect()} == pytest.approx(
        {(0, 0): 297.5, (0, 1): 1.25, (1, 0): 175.0, (3, 0): None, (3, 1): None})


def states(spark):
    rows = []
    for rnd in (1, 2):
        for c in range(3):
            r = 2 + c
            rows += [("m", rnd, c, A, i, j, (i * 7 + j * 3 + c * rnd) % 5 - 1.5) for i in range(r) for j in range(20)]
            rows += [("m", rnd, c, B, i, j, (i * 5 + j * 2 + c + rnd) % 7 - 2.5) for i in range(20) for j in range(r)]
            rows += [("m", rnd, c, H, i, j, (i * 3 + j + c) % 4 / 4) for i in range(4) for j in range(20)]
    cells = spark.createDataFrame(rows, "method string, round int, client_id int, param string, i int, j int, v double")
    meta = spark.createDataFrame([(c, 10 + c) for c in range(3)], "client_id int, n_samples long")
    return cells, meta


def test_pairs_of_vectors_are_no_rows(spark):
    """no table of pairs is kept or moved; both ways to the norms give the direct form's ratios."""
    cells, meta = states(spark)
    cells = cells.where("round = 1").drop("method", "round")
    w, names = state.group_weight(meta), blocks.name_dimension(cells)
    gram = blocks.gram_bias_layers(blocks.to_blocks(cells, names), names, w)
    assert not [k for k in shuffled_by(gram) if re.search(r"\bp#\d+|\bq#\d+", k)]
    direct = linalg.aggregation_bias_layers(cells, w).first()["bias"]
    assert gram.first()["bias"] == pytest.approx(direct, abs=1e-9)


def test_report_on_blocks_equals_the_report_on_cells(spark):
    """the same report from tiles, also with a tile of nulls only, which is nothing sent."""
    cells, meta = states(spark)
    held = spark.createDataFrame([(k, k % 4, [float((k * j) % 3) for j in range(20)]) for k in range(9)],
                                 "example_id long, label int, x array<double>")
    names = blocks.name_dimension(cells)
    parts = blocks.to_blocks(cells, names, ["method", "round", "client_id"])
    parts = parts.unionByName(parts.where("client_id = 0").withColumn("k", F.col("k") + 50)
                              .withColumn("v", F.lit(None).cast("array<double>")))
    a = report.round_report(cells, meta, held).orderBy("round").collect()
    out = report.round_report_blocks(parts, names, meta, held)
    b = out.orderBy("round").collect()
    assert len(a) == 2 and a[0].asDict().keys() == b[0].asDict().keys()
    for x, y in zip(a, b):
        assert all(y[k] == (pytest.approx(x[k], abs=1e-9) if isinstance(x[k], float) else x[k]) for k in x.asDict())
    assert not [k for k in shuffled_by(out) if "param#" in k]


@pytest.mark.parametrize("known", [0, 1, 3, text.KNOWN_WORDS])
def test_known_words_are_not_shuffled(spark, monkeypatch, known):
    """however many words the tasks know, the chunks are the same; equal ids meet; known words make no rows."""
    monkeypatch.setattr(text, "KNOWN_WORDS", known)
    rows = [(1, "b a c a b a d", 0), (2, "", 1), (3, None, 1), (4, "a a", 0), (4, "a a", 0), (None, "c", None)]
    ex = spark.createDataFrame(rows, "example_id long, text string, label int")
    vocab = text.build_vocabulary(ex).where("tok != 'd'")  # a, b, c: 2, 3, 4; d is lacking
    out = text.tokenize_pad(ex, vocab, max_len=3)
    got = sorted(((r["example_id"] or 0, r["labels"], r["n_words"], r["chunk_no"], r["input_ids"], sum(r["attention_mask"]))
                  for r in out.collect()), key=str)
    assert got == sorted([(1, 0, 7, 0, [3, 2, 4], 3), (1, 0, 7, 1, [2, 3, 2], 3), (1, 0, 7, 2, [1, 0, 0], 1), (2, 1, 0, 0, [0, 0, 0], 0),
                          (3, 1, 0, 0, [0, 0, 0], 0), (4, 0, 2, 0, [2, 2, 2, 2], 4), (0, None, 1, 0, [4, 0, 0], 1)], key=str)
    assert "posexplode" not in plan_of(out)
