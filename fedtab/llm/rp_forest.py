"""Embedding near-duplicates by a random-projection tree forest.

Every tree splits the vectors by random directions near the median, again and
again; vectors in a narrow band around a split go to both sides (spill). Only
vectors of one leaf are compared, exactly, and the links of all trees are united.

Trees grow in passes of several levels. A pass fits the split points of a
node on a bounded sample of its vectors, in one grouped task per node, and then sends *every* vector down; nodes that are still too large
are split in another pass. Directions come from a seed, so only split points travel.

A group of near vectors that is larger than a leaf would be cut through by every
split at the median. The fit therefore measures on the node's sample how many links
of such crowded vectors a split separates: it moves the split to the nearest place
that keeps them, and a node in which many pairs link and no place does is settled,
not split any more. Its pairs are all compared, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedtab.llm.common import connected_components, uniform
from fedtab.session import materialize

SEED = 11


@dataclass(frozen=True)
class Forest:
    """``spill``: share of a node's vectors on each side of a split that go to both sides. ``sample``: bound on
    the expected vectors on which one node's split points are fitted. A leaf above ``oversize`` times ``leaf``
    rows is split again; after so many ``passes`` it is compared in blocks of ``block`` rows.

    ``probe``: vectors of a node's sample among which links are counted; from ``sure`` on they can settle a node.
    ``loss``: share of the crowded vectors' links that a split may separate. ``dense``: share of linked pairs from
    which a node that no split keeps together is settled, so comparing it costs at most 1 / ``dense`` pairs a link."""

    trees: int = 16
    leaf: int = 400
    spill: float = 0.04
    sample: int = 16384
    levels: int = 10
    oversize: int = 4
    passes: int = 5
    block: int = 1600
    probe: int = 1024
    sure: int = 32
    loss: float = 0.02
    dense: float = 0.125

    def depth(self, count: int) -> int:
        """Levels to split a node of so many rows at once."""
        return int(min(self.levels, max(0, np.ceil(np.log2(max(count, 1) / self.leaf)))))


def _directions(tree: int, node: int, levels: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([SEED, tree, node & 0xFFFFFFFF, node >> 32]).standard_normal(((1 << levels) - 1, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route(x: np.ndarray, low: np.ndarray, high: np.ndarray, d: np.ndarray, levels: int):
    """Rows and leaves (numbers from 0) of all vectors; a vector between low and high goes both ways."""
    row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(levels):
        p = np.einsum("ij,ij->i", x[row], d[at])
        left, right = p <= high[at], p > low[at]
        row, at = np.concatenate((row[left], row[right])), np.concatenate((2 * at[left] + 1, 2 * at[right] + 2))
    return row, at - ((1 << levels) - 1)


def _place(x: np.ndarray, p: np.ndarray, scale: float, forest: Forest, least: float) -> float | None:
    """Quantile of the projections ``p`` at which to split the sample ``x`` of a node; None settles the node.

    It is the median where no vector has more partners than a leaf has room for (``scale`` rows stand behind each
    sampled one). Else the place nearest to the median that separates few links of such vectors, or the best one.
    """
    step = -(-len(x) // forest.probe)
    x, near, scale = x[::step], p[::step], scale * step
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    crowded = linked.sum(1) * scale > forest.leaf
    if not crowded.any():
        return 0.5
    i, j = np.nonzero(np.triu(linked & (crowded[:, None] | crowded[None, :])))
    first, last = np.minimum(near[i], near[j]), np.maximum(near[i], near[j])
    places = np.array(sorted(np.linspace(0.1, 0.9, 33), key=lambda q: abs(q - 0.5)))
    low, high = (np.quantile(p, np.clip(places + d, 0, 1)) for d in (-forest.spill, forest.spill))
    lost = np.array([np.count_nonzero((first <= a) & (last > b)) for a, b in zip(low, high, strict=True)])
    kept = np.flatnonzero(lost <= forest.loss * len(i))
    if len(kept):
        return float(places[kept[0]])
    if len(x) >= forest.sure and linked.mean() >= forest.dense:
        return None
    return float(places[lost.argmin()])


def _fit(x: np.ndarray, d: np.ndarray, levels: int, scale: float, forest: Forest, least: float):
    """Lower and upper edge of every split's spill band, in heap order, and the leaves that are settled nodes."""
    n = (1 << levels) - 1
    low, high, settled = np.full(n, np.inf), np.full(n, np.inf), []
    inside = {0: np.arange(len(x))}
    for node in range(n):
        rows = inside.pop(node, np.empty(0, int))
        if len(rows) < 2:
            continue  # all go left
        p = x[rows] @ d[node]
        at = _place(x[rows], p, scale, forest, least)
        if at is None:
            while node < n:
                node = 2 * node + 1  # all go left
            settled.append(node - n)
            continue
        low[node], high[node] = np.quantile(p, np.clip((at - forest.spill, at + forest.spill), 0, 1))
        inside[2 * node + 1], inside[2 * node + 2] = rows[p <= high[node]], rows[p > low[node]]
    return low, high, settled


def _fits(sample: DataFrame, forest: Forest, least: float) -> DataFrame:
    """``(dim, tree, node, count, low, high, settled)`` from rows ``(dim, tree, node, count, embedding)`` of a sample."""
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        dim, tree, node, count = (int(rows[c].iloc[0]) for c in ("dim", "tree", "node", "count"))
        levels = forest.depth(count)
        rows = rows.sort_values("id")
        low, high, settled = _fit(_unit(rows["embedding"]), _directions(tree, node, levels, dim), levels,
                                  count / len(rows), forest, least)
        return pd.DataFrame({"dim": [dim], "tree": [tree], "node": [node], "count": [count],
                             "low": [low], "high": [high], "settled": [settled]})
    return sample.groupBy("dim", "tree", "node").applyInPandas(
        fit, "dim int, tree int, node long, count long, low array<double>, high array<double>, settled array<long>")


def _down(rows: DataFrame, forest: Forest) -> DataFrame:
    """Send rows ``(id, dim, tree, node, count, low, high, settled, embedding)`` down: ``(id, dim, tree, node)``.

    Settled nodes have negative numbers.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            for (dim, tree, node), part in batch.groupby(["dim", "tree", "node"], sort=False):
                levels = forest.depth(int(part["count"].iloc[0]))
                if (tree, node, dim) not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    kept[tree, node, dim] = _directions(int(tree), int(node), levels, int(dim))
                low, high = (np.asarray(part[c].iloc[0]) for c in ("low", "high"))
                row, leaf = _route(_unit(part["embedding"]), low, high, kept[tree, node, dim], levels)
                sign = np.where(np.isin(leaf, np.asarray(part["settled"].iloc[0], np.int64)), -1, 1)
                yield pd.DataFrame({"id": part["id"].to_numpy()[row], "dim": dim, "tree": tree,
                                    "node": sign * ((int(node) << forest.levels) + leaf + 1)})
    return rows.mapInPandas(run, "id long, dim int, tree int, node long")


def _grow(vectors: DataFrame, forest: Forest, least: float) -> DataFrame:
    """``(id, dim, tree, node)``: the leaves of every vector of ``(id, dim, embedding)``."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")
    sizes = materialize(vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("count")), "dims")
    draw = uniform(F.concat_ws(":", "id", "tree"), "forest") * F.col("count") < forest.sample
    rooted = vectors.join(sizes, "dim")
    rooted = rooted.select("*", trees).withColumn("node", F.lit(0).cast("long"))
    fits = materialize(_fits(rooted.where(draw), forest, least), "splits")
    # One row of split points per tree and dimension, at most 2 * 1023 doubles each: Spark sends them by their bytes.
    points = fits.select("dim", "tree", "low", "high", "settled")
    rooted = rooted.join(points, ["dim", "tree"])
    state = materialize(_down(rooted, forest), "forest")
    for _ in range(forest.passes):
        sizes = materialize(state.where("node >= 0").groupBy("dim", "tree", "node").agg(F.count(F.lit(1)).alias("count"))
                            .where(F.col("count") > forest.oversize * forest.leaf), "oversize")
        if sizes.isEmpty():
            break
        large = state.join(sizes, ["dim", "tree", "node"]).join(vectors.select("id", "embedding"), "id")
        fits = materialize(_fits(large.where(draw), forest, least), "splits").drop("count")
        moved = _down(large.join(fits, ["dim", "tree", "node"]), forest)
        state = materialize(state.join(sizes, ["dim", "tree", "node"], "left_anti").unionByName(moved), "forest")
    return state


def _fresh(one: np.ndarray, two: np.ndarray, inside: np.ndarray, deep: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows to compare with rows, leaving out what some earlier leaf holds whole.

    ``inside``: which rows lie in which of a few earlier leaves. All pairs within one of them have been compared, so only
    the rows outside are left, against all, and those inside against the ones outside; the same again for these parts.
    """
    if not len(one) or not len(two):
        return
    both = inside[one].sum(0, dtype=np.int64) * inside[two].sum(0, dtype=np.int64) if inside.shape[1] else np.zeros(1, np.int64)
    best = int(both.argmax())
    if not deep or both[best] < 0.05 * len(one) * len(two):
        yield one, two
        return
    a, b = inside[one, best], inside[two, best]
    yield from _fresh(one[~a], two, inside, deep - 1)
    yield from _fresh(one[a], two[~b], inside, deep - 1)


def _earlier(leaves: list[np.ndarray], here: int, most: int = 48) -> np.ndarray:
    """Which rows lie in which of the leaves before ``here`` that hold most of them."""
    row = np.repeat(np.arange(len(leaves)), [len(v) for v in leaves])
    leaf = np.concatenate([np.empty(0, np.int64), *leaves])
    names, at, counts = np.unique(leaf[leaf < here], return_inverse=True, return_counts=True)
    top = np.argsort(-counts, kind="stable")[:most]
    number = np.full(len(names), -1)
    number[top] = np.arange(len(top))
    out = np.zeros((len(leaves), len(top)), bool)
    use = number[at] >= 0
    out[row[leaf < here][use], number[at[use]]] = True
    return out


def _held(leaves: list[np.ndarray], here: int) -> np.ndarray:
    """Which of the leaves before ``here`` each row lies in; leaves of a single row are left out."""
    row = np.repeat(np.arange(len(leaves)), [len(v) for v in leaves])
    leaf = np.concatenate([np.empty(0, np.int64), *leaves])
    before = leaf < here
    names, at, counts = np.unique(leaf[before], return_inverse=True, return_counts=True)
    shared = counts > 1
    out = np.zeros((len(leaves), int(shared.sum())), np.float32)
    number = np.cumsum(shared) - 1
    use = shared[at]
    out[row[before][use], number[at[use]]] = 1
    return out


def _verify(rows: DataFrame, least: float) -> DataFrame:
    """Links within leaves: ``(id, links, low)``; a pair is counted in the first leaf that holds both.

    A large group of near vectors is one leaf's in many trees; its pairs are compared in the first and left out after it.
    """
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids, weight, side = part["id"].to_numpy(), part["copies"].to_numpy(), part["side"].to_numpy()
        here, (p, q) = part["leaf"].iloc[0], (part["p"].iloc[0], part["q"].iloc[0])
        x = np.stack([np.asarray(r, dtype=np.float64) for r in part["embedding"]])
        norm = np.linalg.norm(x, axis=1)
        one, two = ((np.flatnonzero(side == k) for k in (p, q)) if p != q else (np.arange(len(ids)),) * 2)
        good = np.zeros((len(one), len(two)), bool)
        place_one, place_two = np.empty(len(ids), int), np.empty(len(ids), int)
        place_one[one], place_two[two] = np.arange(len(one)), np.arange(len(two))
        for rows, columns in _fresh(one, two, _earlier(part["leaves"].tolist(), here)):
            for at in range(0, len(rows), 256):
                a = rows[at:at + 256]
                good[np.ix_(place_one[a], place_two[columns])] = (x[a] @ x[columns].T) / (norm[a, None] * norm[None, columns]) >= least
        if p == q:
            good = np.triu(good, 1)
        one, two, good = (one[good.any(1)], two[good.any(0)], good[good.any(1)][:, good.any(0)])
        held = _held([part["leaves"].iloc[k] for k in np.r_[one, two]], here)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(one), 256):
            first = (good[at:at + 256] & (held[at:len(one)][:256] @ held[len(one):].T == 0)).astype(np.float64)
            links[one[at:at + 256]] += (first @ weight[two]).astype(np.int64)
            links[two] += (weight[one[at:at + 256]] @ first).astype(np.int64)
        i, j = np.nonzero(good)
        i, j = one[i], two[j]
        while len(i):
            before = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            label = label[label]
            if (label == before).all():
                break
        return pd.DataFrame({"id": ids, "links": links, "low": ids[label]})[(links > 0) | (label != np.arange(len(ids)))]
    return rows.groupBy("leaf", "dim", "p", "q").applyInPandas(run, "id long, links long, low long")


def near_vectors(table: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding",
                 forest: Forest | None = None) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row; two vectors link at cosine >= ``least``.

    Keys are integers. Null vectors, zero vectors and those with null or
    non-finite components link with nothing, neither do vectors of different
    lengths, nor rows whose key is null (their id is null). Equal vectors are compared as one and all link
    with each other; ``n_links`` counts rows. An empty table gives an empty one.
    """
    forest = forest or Forest()
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("embedding"))
    ok = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))),
                    F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where(F.col("key").isNotNull() & ok)
    distinct = (valid.groupBy("embedding").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies"))
                .withColumn("dim", F.size("embedding")))
    # One key with several vectors stands for each of them; the node of a vector is then its hash.
    distinct = materialize(distinct.withColumn("name", F.col("id")).withColumn("id", F.xxhash64("embedding")), "vectors")
    state = _grow(distinct.select("id", "dim", "embedding"), forest, least)
    state = state.select("id", "dim", F.xxhash64("tree", "dim", "node").alias("leaf")).distinct()
    state = materialize(state, "leaves")
    sizes = state.groupBy("leaf", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    leaves = state.groupBy("id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    payload = materialize(distinct.drop("dim", "name").join(leaves, "id"), "payload")
    k = (F.col("n") / F.lit(forest.block)).cast("int") + 1
    dealt = (state.join(sizes, ["leaf", "dim"]).withColumn("side", F.pmod(F.hash("id"), k))
             .withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
             .withColumn("p", F.least("side", "other")).withColumn("q", F.greatest("side", "other"))
             .select("leaf", "dim", "p", "q", "side", "id"))
    found = materialize(_verify(dealt.join(payload, "id"), least), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    names = distinct.select("id", "name", "embedding", "copies", "dim")
    parts = connected_components(found.select("id", "low"), "id", "low").toDF("id", "part")
    named = materialize(names.join(links, "id", "left").join(parts, "id", "left")
                        .withColumn("part", F.coalesce("part", "id")), "named")
    least_name = named.groupBy("part").agg(F.min("name").alias("component_id"))
    of = (named.join(least_name, "part")
          .select(F.col("embedding").alias("_vector"), "component_id",
                  (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = (rows.withColumn("_usable", F.col("key").isNotNull() & ok)
           .join(of, F.col("_usable") & (F.col("embedding") == F.col("_vector")), "left"))
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
