"""Products of low-rank factors and the aggregation-bias metric (#21, #26-#28).

W = B @ A joins the rows of B with the columns of A inside (client, layer), each
row and column one array along the inner index. Sums over clients are folded into
the same dot products or aggregation, so the per-client d x d products are never
materialised as a table of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedtab.functions.params import LORA_A, LORA_B, component, layer_key
from fedtab.operators.positions import range_positions
from fedtab.operators.state import CELL_KEYS as CELL_KEYS_
from fedtab.operators.state import weighted_padded_average, with_total

EPS = 1e-8  # fixed value: ratio epsilon of the bias metric
#: Owners whose factors are stacked in one piece of a product.
OWNERS = 64
#: Inner indices of a dot product that is written out.
SHORT = 8


def _factors(cells: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    # plain substring predicates (same rule as ``component``) reach the scan as PushedFilters
    p = F.col("param")
    is_a, is_b = p.contains(LORA_A), p.contains(LORA_B) & ~p.contains(LORA_A)
    a = cells.filter(is_a).select(*keys, layer_key("param").alias("layer"), F.col("i").alias("k"), "j",
                                  F.col("v").alias("a"))
    b = cells.filter(is_b).select(*keys, layer_key("param").alias("layer"), "i", F.col("j").alias("k"),
                                  F.col("v").alias("b"))
    return a, b


def matrix_product(cells: DataFrame, group_cols: Sequence[str] = ("client_id",),
                   coef: DataFrame | None = None, coef_keys: Sequence[str] = ()) -> DataFrame:
    """#21: W = B @ A per group and layer: (group..., layer, i, j, w).

    With ``coef`` (keys + ``c``), returns sum over the coefficient keys of c * B @ A,
    e.g. the mean over clients when c = 1/K: the client sum happens in the same
    dot product as the inner sum.

    Only factors are shuffled: a layer's rows of B and columns of A are dealt to one task, each with its values along
    the inner index in one array, and an output cell is the dot product of two arrays, made where it is written out.
    With ``coef`` the inner index runs over a layer's owners too, in pieces of about ``OWNERS`` owners, whose
    products are then added.
    """
    g = list(group_cols)
    owner = [k for k in coef_keys if k not in g]
    keys = g + owner
    a, b = _factors(cells, keys)
    by = [*g, "layer"]
    if coef is not None:
        b = b.join(coef.select(*keys, "c"), on=keys, how="inner").withColumn("b", F.col("b") * F.col("c"))
    if owner:
        n_pieces = coef.agg((F.floor(F.count(F.lit(1)) / OWNERS) + 1).alias("n")).scalar()
        a, b = (x.dropna(subset=owner).withColumn("_piece", F.pmod(F.xxhash64(*owner), n_pieces)) for x in (a, b))
        by.append("_piece")
    inner = F.struct(*owner, "k") if owner else F.col("k")
    rows, cols = _along(b, by, inner, owner, "i", "b"), _along(a, by, inner, owner, "j", "a")
    same = F.col("b_at") == F.col("a_at")
    aligned = F.when(same, F.zip_with("b", "a", lambda x, y: x * y)).otherwise(
        F.zip_with("b_at", "b", lambda p, x: x * F.get("a", (F.array_position("a_at", p) - 1).cast("int"))))
    dot = F.aggregate(aligned, F.lit(None).cast("double"),
                      lambda s, v: F.when(v.isNull(), s).otherwise(F.coalesce(s, F.lit(0.0)) + v))
    # short inner indices, the usual ones, are written out and compiled
    terms = [F.get("b", F.lit(o)) * F.get("a", F.lit(o)) for o in range(SHORT)]
    short = F.when(F.coalesce(*terms).isNotNull(), sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)))
    total = F.when(same & (F.size("b") <= SHORT), short).otherwise(dot)
    prod = (rows.join(cols, by).where(same | F.arrays_overlap("b_at", "a_at"))
            .select(*g, "layer", "i", "j", total.alias("w")))
    return prod.groupBy(*g, "layer", "i", "j").agg(F.sum("w").alias("w")) if owner else prod


def _along(factor: DataFrame, by: Sequence[str], inner: Column, owner: Sequence[str], outer: str, value: str) -> DataFrame:
    """One row per (by..., outer): the sorted inner indices (``<value>_at``) and their values; equal cells are added."""
    there = factor.where(F.col("k").isNotNull()).repartition(*by)
    cell = there.groupBy(*by, *owner, "k", outer).agg(F.sum(value).alias(value))
    row = cell.groupBy(*by, outer).agg(F.sort_array(F.collect_list(F.struct(inner.alias("p"), value))).alias("_row"))
    return row.select(*by, outer, F.transform("_row", lambda x: x["p"]).alias(f"{value}_at"),
                      F.transform("_row", lambda x: x[value]).alias(value))


def client_coefficients(weights: DataFrame, group_cols: Sequence[str], weighted: bool,
                        client_col: str = "client_id") -> DataFrame:
    """c_k per (group, client): the weight (paper's form) or 1/K (code's form)."""
    g = list(group_cols)
    if weighted:
        return weights.select(*g, client_col, F.col("weight").alias("c"))
    out = with_total(weights.select(*g, client_col), F.count(F.lit(1)), "_k", g)
    return out.select(*g, client_col, (F.lit(1.0) / F.col("_k")).alias("c"))


def mean_product(cells: DataFrame, weights: DataFrame, group_cols: Sequence[str] = (),
                 weighted: bool = False, client_col: str = "client_id") -> DataFrame:
    """#26: mean over clients of B_k @ A_k per layer (K = clients, not cells)."""
    coef = client_coefficients(weights, group_cols, weighted, client_col)
    return matrix_product(cells, group_cols, coef=coef, coef_keys=[*group_cols, client_col])


def even_positions(n: Column, m: int) -> Column:
    """int(linspace(0, n-1, m)) as an array; every position when n <= m."""
    k = F.sequence(F.lit(0), F.lit(m - 1))
    spread = F.transform(k, lambda x: F.floor(x * (n - 1) / F.lit(m - 1)).cast("long")) if m > 1 \
        else F.array(F.lit(0).cast("long"))
    return F.when(n <= m, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(spread)


def even_layer_sample(layers: DataFrame, m: int = 4, group_cols: Sequence[str] = (),
                      layer_col: str = "layer") -> DataFrame:
    """#28: sort layer names, keep at most ``m`` at int(linspace(0, n-1, m)).

    Positions come from sorted pieces, so no task holds all names.
    """
    g = list(group_cols)
    ranked = range_positions(layers.select(*g, layer_col), g, [F.col(layer_col)])
    ranked = with_total(ranked, F.count(F.lit(1)), "_n", g)
    return (ranked.filter(F.array_contains(even_positions(F.col("_n"), m), F.col("pos")))
            .select(*g, layer_col, "pos"))


def measured_layers(cells: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Layers that have both factors in the state: distinct names first, then a tiny group-by."""
    g = list(group_cols)
    p = F.col("param")
    names = cells.filter(p.contains(LORA_A) | p.contains(LORA_B)).select(*g, "param").distinct()
    comp = component("param")
    return (names
            .groupBy(*g, layer_key("param").alias("layer"))
            .agg(F.countDistinct(comp).alias("_nf"))
            .filter(F.col("_nf") == 2).drop("_nf"))


def _terms(prod: DataFrame, g: list[str], ideal: bool) -> DataFrame:
    """Products of one side as signed terms: what they add to the ideal and to its difference from the average."""
    w = F.col("term")
    return prod.select(*g, "layer", "i", "j", (w if ideal else F.lit(0.0)).alias("ideal"), (w if ideal else -w).alias("diff"))


def _pairs(cells: DataFrame, keys: Sequence[str], coef: DataFrame | None = None) -> DataFrame:
    """Every product b * a (times ``c``) before its sum, with the keys of the factors."""
    a, b = _factors(cells, keys)
    prod = b.join(a, on=[*keys, "layer", "k"], how="inner")
    term = F.col("b") * F.col("a")
    if coef is not None:
        prod = prod.join(coef.select(*keys, "c"), on=list(keys), how="inner")
        term = term * F.col("c")
    return prod.withColumn("term", term)


def _bias_of(terms: DataFrame, g: list[str]) -> DataFrame:
    """Ideal and difference in one sum per output cell, then the ratio of norms per layer."""
    cell = terms.groupBy(*g, "layer", "i", "j").agg(F.sum("ideal").alias("ideal"), F.sum("diff").alias("diff"))
    return (cell.groupBy(*g, "layer")
            .agg(F.sqrt(F.sum(F.col("diff") * F.col("diff"))).alias("num"),
                 F.sqrt(F.sum(F.col("ideal") * F.col("ideal"))).alias("den"))
            .select(*g, "layer", (F.col("num") / (F.col("den") + F.lit(EPS))).alias("bias")))


def aggregation_bias_layers(cells: DataFrame, weights: DataFrame, group_cols: Sequence[str] = (),
                            max_layers: int | None = None, weighted: bool = False,
                            client_col: str = "client_id") -> DataFrame:
    """#27 per layer: ||ideal - B_avg @ A_avg||_F / (||ideal||_F + 1e-8).

    ideal = mean_k B_k @ A_k (``weighted``: sum_k w_k B_k @ A_k, the paper's form).
    Every layer that has both factors is measured; ``max_layers`` samples them
    evenly (#28). The averaged pair joins the sum as a pseudo-client of coefficient
    -1, so one aggregation per output cell gives both the ideal and the difference.
    """
    g = list(group_cols)
    chosen = measured_layers(cells, g)
    if max_layers is not None:
        chosen = even_layer_sample(chosen, max_layers, g)
    cs = (cells.withColumn("layer", layer_key("param"))
          .join(chosen.select(*g, "layer"), on=[*g, "layer"], how="left_semi")
          .drop("layer"))
    coef = client_coefficients(weights, g, weighted, client_col)
    avg = weighted_padded_average(cs, weights, g, client_col)
    return _bias_of(_terms(_pairs(cs, [*g, client_col], coef), g, True).unionByName(_terms(_pairs(avg, g), g, False)), g)


def aggregation_bias(cells: DataFrame, weights: DataFrame, groups: DataFrame, group_cols: Sequence[str],
                     max_layers: int | None = None, weighted: bool = False, client_col: str = "client_id") -> DataFrame:
    """#27 per group: mean bias over measured layers; 0.0 when no layer has both
    factors (trap T2), with ``n_layers_measured`` saying so. ``groups`` is the spine."""
    g = list(group_cols)
    per_layer = aggregation_bias_layers(cells, weights, g, max_layers, weighted, client_col)
    return summarise_bias(per_layer, groups, g)


def frozen_factor_bias_layers(sent: DataFrame, frozen: DataFrame, weights: DataFrame, group_cols: Sequence[str],
                              max_layers: int | None = None, weighted: bool = False,
                              client_col: str = "client_id") -> DataFrame:
    """#27 with ``carry_frozen`` (trap T2): a factor not sent this round is the shared
    global one, taken un-averaged; each client uses it cropped to its rank.

    ``sent`` = this round's client cells; ``frozen`` = (group..., param, i, j, v), the
    global state's factors that were not sent. For a layer with both factors sent,
    ideal = sum_k c_k B_k A_k. With one factor frozen (say G_A), cropping comes from the
    inner-index join, so ideal = (sum_k c_k B_k) G_A and fed = B_avg G_A: two products
    of averaged factors, never a per-client copy of G. c_k = w_k makes them equal,
    so the weighted bias of a shared factor is 0 (SURVEY §5).
    """
    g = list(group_cols)
    p = F.col("param")
    sent_names = sent.select(*g, "param").distinct()
    # frozen factors only where nobody sent that parameter this round
    frozen = frozen.join(sent_names, on=[*g, "param"], how="left_anti")
    names = sent_names.withColumn("_sent", F.lit(1)).unionByName(
        frozen.select(*g, "param").distinct().withColumn("_sent", F.lit(0)))
    names = names.filter(p.contains(LORA_A) | p.contains(LORA_B))
    by_layer = names.groupBy(*g, layer_key("param").alias("layer")).agg(
        F.countDistinct(component("param")).alias("_nf"), F.sum("_sent").alias("_n_sent_factors"))
    measured = by_layer.filter((F.col("_nf") == 2) & (F.col("_n_sent_factors") >= 1))
    if max_layers is None:
        chosen = measured.select(*g, "layer", "_n_sent_factors")
    else:
        chosen = even_layer_sample(measured.select(*g, "layer"), max_layers, g).join(
            measured.select(*g, "layer", "_n_sent_factors"), on=[*g, "layer"])
    both = chosen.filter(F.col("_n_sent_factors") == 2).select(*g, "layer")
    half = chosen.filter(F.col("_n_sent_factors") == 1).select(*g, "layer")

    def restrict(df: DataFrame, layers: DataFrame) -> DataFrame:
        return (df.withColumn("layer", layer_key("param")).join(layers, on=[*g, "layer"], how="left_semi")
                .drop("layer"))

    coef = client_coefficients(weights, g, weighted, client_col)
    sent_both, sent_half = restrict(sent, both), restrict(sent, half)
    frozen_half = restrict(frozen, half).select(*g, *CELL_KEYS_, "v")
    shared = weighted_padded_average(sent_half, coef.withColumnRenamed("c", "weight"), g, client_col).unionByName(frozen_half)
    sent_avg = weighted_padded_average(restrict(sent, chosen.select(*g, "layer")), weights, g, client_col)
    terms = (_terms(_pairs(sent_both, [*g, client_col], coef), g, True)
             .unionByName(_terms(_pairs(shared, g), g, True))
             .unionByName(_terms(_pairs(sent_avg.unionByName(frozen_half), g), g, False)))
    return _bias_of(terms, g)


def summarise_bias(per_layer: DataFrame, groups: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Mean over measured layers per group; 0.0 and ``n_layers_measured`` 0 when none."""
    g = list(group_cols)
    agg = per_layer.groupBy(*g).agg(F.avg("bias").alias("bias"), F.count(F.lit(1)).alias("n_layers_measured"))
    out = groups.select(*g).distinct().join(agg, on=g, how="left")
    return out.select(*g, F.coalesce(F.col("bias"), F.lit(0.0)).alias("bias"),
                      F.coalesce(F.col("n_layers_measured"), F.lit(0)).cast("long").alias("n_layers_measured"))
