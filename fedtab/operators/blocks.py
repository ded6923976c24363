"""Parameter states as blocked tensors (#19, #20, #24, #25, #27).

A state is a table ``(…, client_id, param_id, k, t, v)`` beside a dimension of
names ``(param_id, param, layer, component, by_column)``. ``k`` numbers a
tensor's vectors along its rank (rows of A and of a head, columns of B), ``t`` the
tiles of ``WIDTH`` values along the other side, and ``v`` holds a tile's values,
null where a cell is missing. Element-wise sums are ``WIDTH`` plain sums side by
side, so they are combined before the shuffle and stay in generated code, and a
row that is moved carries ``WIDTH`` cells under two numbers instead of one cell
under a name.

The bias of averaging factors (#27) has a form without d x d cells here: stack the
clients' factors and the averaged pair along their ranks, B = [c1 B1 ... -B'],
A = [A1; ...; A']. Then ideal - average = B A, and its squared norm is the trace of
(BᵀB)(AAᵀ): a sum over pairs of stacked ranks of two dot products.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedtab.functions.params import component, layer_key
from fedtab.operators.linalg import EPS, client_coefficients
from fedtab.operators.positions import range_positions
from fedtab.session import materialize

#: Values of a tile.
WIDTH = 16
KEYS = ("param_id", "k", "t")


def name_dimension(names: DataFrame) -> DataFrame:
    """``(param_id, param, layer, component, by_column)`` of distinct names ``(param)``, numbered by name from 0."""
    numbered = range_positions(names.select("param").distinct(), [], [F.col("param")], "param_id")
    comp = component("param")
    return numbered.select(F.col("param_id").cast("int").alias("param_id"), "param", layer_key("param").alias("layer"),
                           comp.alias("component"), (comp == "lora_B").alias("by_column"))


def blocks_of_vectors(vectors: DataFrame, group_cols: Sequence[str], dimension: DataFrame) -> DataFrame:
    """Blocks of ``(groups…, param, k, x)``: whole vectors along the tensors' long side. Nothing but the names is joined."""
    tiles = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(size(x) - 1) div {WIDTH}").cast("int")))
    cut = F.slice("x", F.col("t") * WIDTH + 1, WIDTH)
    padded = F.concat(cut, F.array_repeat(F.lit(None).cast("double"), F.lit(WIDTH) - F.size(cut)))
    return (vectors.join(dimension.select("param_id", "param"), "param").withColumn("t", F.explode(tiles))
            .select(*group_cols, "param_id", F.col("k").cast("int").alias("k"), "t", padded.alias("v")))


def to_blocks(cells: DataFrame, dimension: DataFrame, group_cols: Sequence[str] = ("client_id",)) -> DataFrame:
    """Blocks of a table of cells ``(groups…, param, i, j, v)``; of equal cells the largest value counts."""
    named = cells.join(dimension.select("param_id", "param", "by_column"), "param")
    at = F.when(F.col("by_column"), F.col("i")).otherwise(F.col("j"))
    placed = named.select(*group_cols, "param_id", F.when(F.col("by_column"), F.col("j")).otherwise(F.col("i")).cast("int").alias("k"),
                          F.floor(at / WIDTH).cast("int").alias("t"), (at % WIDTH).alias("_o"), "v")
    return _packed(placed.groupBy(*group_cols, *KEYS), [F.max(F.when(F.col("_o") == o, F.col("v"))) for o in range(WIDTH)])


def _packed(grouped, values: list[Column]) -> DataFrame:
    """One aggregate per place of a tile, then the tile. (An array of aggregates would not be combined place by place.)"""
    out = grouped.agg(*[v.alias(f"_v{o}") for o, v in enumerate(values)])
    names = [f"_v{o}" for o in range(WIDTH)]
    return out.select(*[c for c in out.columns if c not in names], F.array(*names).alias("v"))


def to_cells(blocks: DataFrame, dimension: DataFrame) -> DataFrame:
    """The cells of a table of blocks: ``(groups…, param, i, j, v)``."""
    groups = [c for c in blocks.columns if c not in (*KEYS, "v")]
    flat = (blocks.select(*groups, *KEYS, F.posexplode("v").alias("_o", "_x")).where("_x is not null")
            .join(dimension.select("param_id", "param", "by_column"), "param_id"))
    at = F.col("t") * WIDTH + F.col("_o")
    return flat.select(*groups, "param", F.when(F.col("by_column"), at).otherwise(F.col("k")).cast("int").alias("i"),
                       F.when(F.col("by_column"), F.col("k")).otherwise(at).cast("int").alias("j"), F.col("_x").alias("v"))


def average_blocks(blocks: DataFrame, weights: DataFrame, group_cols: Sequence[str] = (), client_col: str = "client_id") -> DataFrame:
    """#24 on blocks: sum of weight times value, place by place; a cell that no client has stays null."""
    g = list(group_cols)
    joined = blocks.join(weights.select(*g, client_col, "weight"), [*g, client_col])
    return _packed(joined.groupBy(*g, *KEYS), [F.sum(F.col("weight") * F.get("v", F.lit(o))) for o in range(WIDTH)])


def summed_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The blocks of each key added place by place; a place that none has stays null."""
    return _packed(blocks.groupBy(*keys), [F.sum(F.get("v", F.lit(o))) for o in range(WIDTH)])


def overlay_blocks(local: DataFrame, global_: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """#19 on blocks: global values where both have a cell; the local side fixes the shape."""
    g = list(group_cols)
    out = local.join(global_.select(*g, *KEYS, F.col("v").alias("_g")), [*g, *KEYS], "left")
    both = F.zip_with("v", "_g", lambda x, y: F.when(x.isNotNull(), F.coalesce(y, x)))
    return out.withColumn("v", F.coalesce(both, F.col("v"))).drop("_g")


def present_blocks(blocks: DataFrame, other: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """#20 on blocks: the tensors whose name the other side has."""
    return blocks.join(other.select(*group_cols, "param_id").distinct(), [*group_cols, "param_id"], "left_semi")


def max_shapes(blocks: DataFrame, dimension: DataFrame, client_col: str = "client_id") -> DataFrame:
    """#25 on blocks: ``(param, n_rows, n_cols, n_clients)``, the largest shape of every name."""
    used = F.array_max(F.transform("v", lambda x, o: F.when(x.isNotNull(), o + 1)))
    own = blocks.groupBy(client_col, "param_id").agg((F.max("k") + 1).alias("_k"), F.max(F.col("t") * WIDTH + used).alias("_l"))
    shape = own.groupBy("param_id").agg(F.max("_k").alias("_k"), F.max("_l").alias("_l"), F.count(F.lit(1)).alias("n_clients"))
    flip = F.col("by_column")
    return shape.join(dimension.select("param_id", "param", "by_column"), "param_id").select(
        "param", F.when(flip, F.col("_l")).otherwise(F.col("_k")).alias("n_rows"),
        F.when(flip, F.col("_k")).otherwise(F.col("_l")).alias("n_cols"), "n_clients")


def _factors(blocks: DataFrame, dimension: DataFrame) -> DataFrame:
    """The blocks of factors with their layer and which factor they belong to."""
    return blocks.join(dimension.where(F.col("component").isin("lora_A", "lora_B")).select("param_id", "layer", "component"), "param_id")


def _vectors(blocks: DataFrame, g: list[str], kind: int, of: Column, ideal: Column, diff: Column) -> DataFrame:
    """Vectors of a stack, named by (kind, owner, k), with their coefficients in the ideal and in its difference from the average."""
    return blocks.select(*g, "layer", "component", F.struct(F.lit(kind).alias("kind"), of.cast("long").alias("of"), "k").alias("p"), "t", "v",
                         ideal.cast("double").alias("ideal"), diff.cast("double").alias("diff"))


def _stack(table: pa.Table, owners: np.ndarray, n: int, component: str) -> np.ndarray:
    """One factor of a stack as a matrix, a vector to a row; 0 where a tile or a cell is missing."""
    mine = table.column("component").to_numpy() == component
    there = mine & table.column("v").is_valid().to_numpy()
    t = table.column("t").to_numpy()
    out = np.zeros((n, int(t[mine].max()) + 1 if mine.any() else 1, WIDTH))
    values = table.column("v").filter(pa.array(there)).combine_chunks().flatten().fill_null(0.0)
    np.add.at(out, (owners[there], t[there]), values.to_numpy(zero_copy_only=False).reshape(-1, WIDTH))
    return out.reshape(n, -1)


def _norms(table: pa.Table) -> tuple[float, float]:
    """Norms of the ideal and of its difference from the average, of one layer's stack."""
    p = table.column("p").combine_chunks()
    _, first, owners = np.unique(np.stack([p.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "of", "k")]), axis=1,
                                 return_index=True, return_inverse=True)
    owners = owners.reshape(-1)
    a, b = (_stack(table, owners, len(first), c) for c in ("lora_A", "lora_B"))
    coefs = [table.column(c).to_numpy()[first] for c in ("ideal", "diff")]
    if a.shape[1] * b.shape[1] <= len(a) * (a.shape[1] + b.shape[1]):  # fewer cells in the product than pairs to multiply
        return tuple(float(np.linalg.norm((b * c[:, None]).T @ a)) for c in coefs)
    gram = (a @ a.T) * (b @ b.T)
    return tuple(float(np.sqrt(np.maximum(c @ gram @ c, 0.0))) for c in coefs)


def _ratios(stacked: DataFrame, g: list[str]) -> DataFrame:
    """The bias per layer from its stack: products of the two stacked factors, and the two norms.

    A layer's stack is one group, as large as its two factors over all clients: the smaller of the matrix of dot
    products of its vectors and the product itself is formed at once there, so no pair and no cell becomes a row.
    """
    keys = [*g, "layer"]

    def ratio(key: tuple, table: pa.Table) -> pa.Table:
        ideal, diff = _norms(table)
        bias = pa.array([diff / (ideal + EPS)], pa.float64())
        return pa.Table.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), bias], names=[*keys, "bias"])

    schema = T.StructType([*(stacked.schema[k] for k in keys), T.StructField("bias", T.DoubleType())])
    return stacked.where(F.col("layer").isNotNull()).groupBy(*keys).applyInArrow(ratio, schema)


def gram_bias_layers(blocks: DataFrame, dimension: DataFrame, weights: DataFrame, group_cols: Sequence[str] = (),
                     weighted: bool = False, client_col: str = "client_id") -> DataFrame:
    """#27 per layer by Gram matrices: the same ratio as ``linalg.aggregation_bias_layers``, with no d x d cell.

    Work grows with the square of the stacked rank (all clients' ranks and the averaged pair's) times d, where the
    direct form's grows with that rank times d squared: use it where d is larger than the ranks together. Squared
    norms are sums of terms of both signs, so a ratio below about 1e-7 cannot be told from 0 here; the direct form can.
    """
    g = list(group_cols)
    factors = _factors(blocks, dimension)
    both = (factors.select(*g, "layer", "component").distinct().groupBy(*g, "layer").agg(F.count(F.lit(1)).alias("_n"))
            .where("_n = 2").select(*g, "layer"))
    factors = factors.join(both, [*g, "layer"], "left_semi")
    coef = client_coefficients(weights, g, weighted, client_col)
    own = _vectors(factors.join(coef, [*g, client_col]), g, 0, F.col(client_col), F.col("c"), F.col("c"))
    average = _factors(average_blocks(factors.drop("layer", "component"), weights, g, client_col), dimension)
    return _ratios(own.unionByName(_vectors(average, g, 1, F.lit(0), F.lit(0.0), F.lit(-1.0))), g)


def frozen_gram_bias_layers(sent: DataFrame, frozen: DataFrame, dimension: DataFrame, weights: DataFrame, group_cols: Sequence[str] = (),
                            weighted: bool = False, client_col: str = "client_id") -> DataFrame:
    """#27 with ``carry_frozen`` by Gram matrices: the same ratios as ``linalg.frozen_factor_bias_layers``.

    ``sent`` = this round's client blocks; ``frozen`` = (groups…, param_id, k, t, v), the global state. A factor that
    nobody sent is the frozen one, un-averaged. In a layer with one frozen factor the clients' coefficients add up
    before the product, so the stack holds two pairs: (sum of c_k B_k, G) of the ideal and (average, G) of the average.
    """
    g = list(group_cols)
    frozen = frozen.join(sent.select(*g, "param_id").distinct(), [*g, "param_id"], "left_anti")
    names = (_factors(sent.select(*g, "param_id").distinct().withColumn("_sent", F.lit(1)).unionByName(
        frozen.select(*g, "param_id").distinct().withColumn("_sent", F.lit(0))), dimension))
    layers = (names.groupBy(*g, "layer").agg(F.countDistinct("component").alias("_n"), F.sum("_sent").alias("_sent"))
              .where("_n = 2 and _sent >= 1").select(*g, "layer", "_sent"))
    layers = materialize(layers, "measured-layers")
    coef = client_coefficients(weights, g, weighted, client_col)
    sent, frozen = _factors(sent, dimension).join(layers, [*g, "layer"]), _factors(frozen, dimension).join(layers, [*g, "layer"])
    own = _vectors(sent.where("_sent = 2").join(coef, [*g, client_col]), g, 0, F.col(client_col), F.col("c"), F.col("c"))
    still = frozen.where("_sent = 1").select(*g, "layer", "component", "k", "t", "v")
    plain = lambda df, w: _factors(average_blocks(df.select(*g, client_col, *KEYS, "v"), w, g, client_col), dimension).select(
        *g, "layer", "component", "k", "t", "v")
    shared = plain(sent.where("_sent = 1"), coef.withColumnRenamed("c", "weight")).unionByName(still)
    average = plain(sent, weights).unionByName(still)
    return _ratios(own.unionByName(_vectors(shared, g, 1, F.lit(0), F.lit(1.0), F.lit(1.0)))
                   .unionByName(_vectors(average, g, 2, F.lit(0), F.lit(0.0), F.lit(-1.0))), g)


def blocks_as_of(sent: DataFrame, weights: DataFrame, run_cols: Sequence[str], last_round: int, client_col: str = "client_id") -> DataFrame:
    """``state.global_as_of`` on blocks: the global state after every round, each tensor from the latest round that sent it."""
    g = list(run_cols)
    avg = average_blocks(sent, weights, [*g, "round"], client_col)
    names = sent.select(*g, "round", "param_id").distinct()
    offered = names.withColumn("_as_of", F.explode(F.sequence(F.col("round"), F.lit(last_round))))
    latest = offered.groupBy(*g, "_as_of", "param_id").agg(F.max("round").alias("round"))
    return avg.join(latest, [*g, "round", "param_id"]).select(*g, F.col("_as_of").alias("round"), *KEYS, "v")
