"""Blocked tensors: the same states as cells, and the Gram form of the aggregation bias."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedtab.operators import blocks, linalg, state

CELLS = "client_id int, param string, i int, j int, v double"


def params(layer):
    return f"{layer}.lora_A.default.weight", f"{layer}.lora_B.default.weight", f"{layer}.score.weight"


def random_state(seed, clients=4, layers=2, d=37):
    """Cells of clients with ranks 2 and 5, and a ragged head whose last row is cut short."""
    rng, rows = np.random.default_rng(seed), []
    for c in range(clients):
        r = 2 if c % 2 else 5
        for la in range(layers):
            a, b, h = params(f"m.{la}")
            if not (c == 3 and la == 1):  # one client lacks a layer
                rows += [(c, a, i, j, float(rng.normal())) for i in range(r) for j in range(d)]
                rows += [(c, b, i, j, float(rng.normal())) for i in range(d) for j in range(r)]
            rows += [(c, h, i, j, float(rng.normal())) for i in range(3) for j in range(d if i < 2 else 5)]
    return rows


@pytest.fixture(scope="module")
def cells(spark):
    df = spark.createDataFrame(random_state(1), CELLS)
    names = blocks.name_dimension(df)
    return df, names, blocks.to_blocks(df, names)


def weights_of(spark, clients=4):
    return state.group_weight(spark.createDataFrame([(c, 10 * (c + 1)) for c in range(clients)], "client_id int, n_samples long"))


def table(df, places=12):
    return sorted(tuple(round(x, places) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_cells_to_blocks_and_back(cells):
    df, names, parts = cells
    assert table(blocks.to_cells(parts, names).select(*df.columns)) == table(df)
    assert parts.where(F.size("v") != blocks.WIDTH).count() == 0


def test_average_overlay_and_presence_equal_the_cell_forms(spark, cells):
    df, names, parts = cells
    w = weights_of(spark)
    avg, avg_parts = state.weighted_padded_average(df, w), blocks.average_blocks(parts, w)
    assert table(blocks.to_cells(avg_parts, names).select("param", "i", "j", "v")) == table(avg.select("param", "i", "j", "v"))
    some = df.where("client_id = 1 and param like 'm.0%'")  # the global lacks names and is smaller than some clients
    over = blocks.overlay_blocks(parts, blocks.to_blocks(some, names, []))
    assert table(blocks.to_cells(over, names).select(*df.columns)) == table(state.state_overlay(df, some).select(*df.columns))
    kept = blocks.present_blocks(parts, blocks.to_blocks(some, names))
    assert table(blocks.to_cells(kept, names).select(*df.columns)) == table(state.key_presence_filter(df, some).select(*df.columns))


def test_largest_shapes(cells):
    df, names, parts = cells
    own = df.groupBy("client_id", "param").agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols"))
    assert table(blocks.max_shapes(parts, names)) == table(state.param_max_shape(own))


@pytest.mark.parametrize("weighted", [False, True])
def test_gram_form_equals_the_direct_form(spark, cells, weighted):
    df, names, parts = cells
    w = weights_of(spark)
    direct = {r["layer"]: r["bias"] for r in linalg.aggregation_bias_layers(df, w, weighted=weighted).collect()}
    gram = {r["layer"]: r["bias"] for r in blocks.gram_bias_layers(parts, names, w, weighted=weighted).collect()}
    assert gram.keys() == direct.keys() and len(gram) == 2
    assert all(gram[k] == pytest.approx(direct[k], abs=1e-6) for k in gram)


def test_equal_clients_have_no_bias(spark):
    """The ratio is 0; the direct form gives it exactly, the Gram form to the square root of the rounding error."""
    one = [r for r in random_state(2, clients=1, layers=1)]
    df = spark.createDataFrame([(c, *r[1:]) for c in range(3) for r in one], CELLS)
    names, w = blocks.name_dimension(df), weights_of(spark, 3)
    assert linalg.aggregation_bias_layers(df, w).first()["bias"] < 1e-12
    assert blocks.gram_bias_layers(blocks.to_blocks(df, names), names, w).first()["bias"] < 1e-6


def test_empty_state(spark):
    df = spark.createDataFrame([], CELLS)
    names = blocks.name_dimension(df)
    parts = blocks.to_blocks(df, names)
    assert names.collect() == parts.collect() == blocks.average_blocks(parts, weights_of(spark)).collect() == []
    assert blocks.gram_bias_layers(parts, names, weights_of(spark)).collect() == []


def test_frozen_factors_equal_the_direct_form(spark):
    """Rounds that send both factors, one of them, or a layer that lacks one."""
    rows = []
    for c, param, i, j, v in random_state(3):
        for rnd, skip in ((1, None), (2, "lora_A"), (3, "lora_B")):
            if skip not in param if skip else True:
                rows.append(("m", rnd, c, param, i, j, v * (1 + rnd * (c + 1) / 10)))
    sent = spark.createDataFrame(rows, "method string, round int, " + CELLS)
    clients = spark.createDataFrame([("m", r, c, 10 * (c + 1)) for r in (1, 2, 3) for c in range(4)],
                                    "method string, round int, client_id int, n_samples long")
    g = ["method", "round"]
    w = state.group_weight(clients, partition_cols=g)
    frozen = state.global_as_of(sent, w, ["method"], 3)
    names = blocks.name_dimension(sent)
    parts = blocks.to_blocks(sent, names, [*g, "client_id"])
    as_of = blocks.blocks_as_of(parts, w, ["method"], 3)
    assert table(blocks.to_cells(as_of, names).select(*g, "param", "i", "j", "v")) == table(frozen.select(*g, "param", "i", "j", "v"))
    for weighted in (False, True):
        direct = {(r["round"], r["layer"]): r["bias"] for r in linalg.frozen_factor_bias_layers(sent, frozen, w, g, weighted=weighted).collect()}
        gram = {(r["round"], r["layer"]): r["bias"] for r in blocks.frozen_gram_bias_layers(parts, as_of, names, w, g, weighted).collect()}
        assert gram.keys() == direct.keys() and len(gram) == 6
        assert all(gram[k] == pytest.approx(direct[k], abs=1e-6) for k in gram)
