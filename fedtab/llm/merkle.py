"""Merkle manifest of a dataset, by time-forward processing.

Each source's leaves, in order of their key, are the lowest nodes of a tree in
which every ``ARITY`` consecutive nodes have one parent; the sources' roots are
the leaves of one more tree. A digest is computed from a node's children, so it
has to travel from child to parent, and a proof is what lies beside the way from
a leaf to the root, so it travels back.

Nodes are labelled (last leaf below the node, level): children come before their
parent. A sweep over the leaves in order sends each digest into a priority queue
under its parent's label and takes it out when that label is next, so the queue
holds a few digests a level. The reversed sweep sends to every child the proof of
its parent and the digests beside the child.

Trees are cut into strata of ``STRATUM`` levels, and a stratum into blocks of
``ARITY ** STRATUM`` nodes. Spark sorts a stratum's messages by (tree, block,
position), an external queue between the tasks, and each block is swept in some
task: no task holds more than one block, whatever a source's size. Digests of the
strata are written to the shared folder, so a lost executor repeats its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fedtab.operators.positions import range_positions
from fedtab.session import materialize

ARITY = 3
#: Levels that one sweep covers: blocks of 3 ** 8 = 6,561 nodes.
STRATUM = 8
#: Hexadecimal characters of a digest.
WIDTH = 64


def leaf_digest(fields: list[str | Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, ``:`` and the value; a null as ``-``."""
    parts = []
    for f in fields:
        value = (F.col(f) if isinstance(f, str) else f).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def sweep_forward(leaves: list[str], levels: int) -> list[list[str]]:
    """Digests of one block's nodes, level by level, from those of its lowest ones.

    ``levels``: how far up, at least as far as needed if it is the last stratum of its tree.
    """
    n, queue = len(leaves), []
    nodes: list[list[str]] = [list(leaves), *([] for _ in range(levels))]

    def send(level: int, at: int, digest: str) -> None:
        """The digest of node ``at`` of a level goes to its parent, labelled (last leaf below it, its level)."""
        if level < levels:
            last = min((at // ARITY + 1) * ARITY ** (level + 1), n) - 1
            heappush(queue, (last, level + 1, at, digest))

    for i, leaf in enumerate(leaves):
        send(0, i, leaf)
        while queue and queue[0][0] <= i:
            label, children = queue[0][:2], []
            while queue and queue[0][:2] == label:
                _, level, at, digest = heappop(queue)
                children.append(digest)
            nodes[level].append(_digest(children))
            send(level, at // ARITY, nodes[level][-1])
    return nodes


def sweep_back(nodes: list[list[str]], proof: str, path: str) -> list[tuple[str, str]]:
    """``(proof, path)`` of every lowest node of a block, given those of its top node.

    A proof is the digests beside a node and its ancestors, from the lowest level
    up and left to right; a path says per level which child the node is and of how many.
    """
    n, top = len(nodes[0]), len(nodes) - 1
    # Labels of a reversed sweep: what came last comes first.
    queue: list[tuple[int, int, int, str, str]] = [(1 - n, -top, 0, proof, path)]
    out: list[tuple[str, str]] = [("", "")] * n
    while queue:
        _, level, at, proof, path = heappop(queue)
        level = -level
        if level == 0:
            out[at] = proof, path
            continue
        run = nodes[level - 1][ARITY * at:ARITY * (at + 1)]
        for k in range(len(run)):
            child = ARITY * at + k
            last = min((child + 1) * ARITY ** (level - 1), n) - 1
            heappush(queue, (-last, 1 - level, child, "".join(run[:k] + run[k + 1:]) + proof, f"{k}{len(run)}{path}"))
    return out


def fold(leaf: str, proof: str, path: str) -> str:
    """The root that a leaf and its proof give."""
    at, digest = 0, leaf
    for i in range(0, len(path), 2):
        k, n = int(path[i]), int(path[i + 1])
        beside = proof[at:at + (n - 1) * WIDTH]
        at += (n - 1) * WIDTH
        digest = sha256((beside[:k * WIDTH] + digest + beside[k * WIDTH:]).encode()).hexdigest()
    return digest


def _levels_left(n: int) -> int:
    left = 0
    while n > 1:
        n, left = -(-n // ARITY), left + 1
    return left


def _blocks(nodes: DataFrame, stratum: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY ** stratum).cast("long"))


def _swept(rows: pd.DataFrame, stratum: int) -> list[list[str]]:
    """A block's nodes: all levels of a stratum, or as many as its tree has left."""
    whole = int(rows["n"].iloc[0])
    return sweep_forward(rows["digest"].tolist(), stratum if whole > ARITY ** stratum else _levels_left(whole))


def _up(nodes: DataFrame, stratum: int) -> DataFrame:
    """Nodes ``(tree, pos, n, digest)`` of one stratum -> those of the next, one per block."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        top = _swept(rows.sort_values("pos"), stratum)[-1][0]
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "pos": [rows["block"].iloc[0]],
                             "n": [-(-int(rows["n"].iloc[0]) // ARITY ** stratum)], "digest": [top]})
    return (_blocks(nodes.select("tree", "pos", "n", "digest"), stratum).groupBy("tree", "block")
            .applyInPandas(run, "tree string, pos long, n long, digest string"))


def _down(nodes: DataFrame, tops: DataFrame, stratum: int) -> DataFrame:
    """Add proof and path to one stratum's nodes from those of the next: ``tops`` = (tree, pos, proof, path)."""
    names = [*nodes.columns, "proof", "path"]

    def run(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        found = sweep_back(_swept(rows, stratum), top["proof"].iloc[0], top["path"].iloc[0])
        return rows.assign(proof=[p for p, _ in found], path=[p for _, p in found])[names]
    return (_blocks(nodes, stratum).groupBy("tree", "block")
            .cogroup(tops.select("tree", F.col("pos").alias("block"), "proof", "path").groupBy("tree", "block"))
            .applyInPandas(run, StructType([*nodes.schema.fields, StructField("proof", StringType()),
                                            StructField("path", StringType())])))


def _strata(nodes: DataFrame, stratum: int) -> list[DataFrame]:
    """The nodes of every stratum, the given ones first, the trees' roots last."""
    strata = [nodes]
    while (strata[-1].agg(F.max("n")).first()[0] or 0) > 1:
        strata.append(materialize(_up(strata[-1], stratum), "nodes"))
    return strata


def _proofs(strata: list[DataFrame], tops: DataFrame, stratum: int) -> DataFrame:
    """Proofs of the lowest stratum, swept back from those of the trees' roots."""
    below = strata[:-1] or strata
    for nodes in reversed(below[1:]):
        tops = materialize(_down(nodes, tops, stratum), "proofs")
    return _down(below[0], tops, stratum)


def _placed(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Positions in their trees and the trees' sizes."""
    sizes = materialize(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree-sizes")
    return materialize(range_positions(nodes, ["tree"], order).join(sizes, "tree"), "placed")


def merkle_manifest(leaves: DataFrame, tree: str = "source", order: str = "doc_id", leaf: str = "leaf",
                    stratum: int = STRATUM) -> DataFrame:
    """Root, subroot, proof and path of every row of a table of leaves.

    ``leaf``: digests in hexadecimal. The rows of one ``tree`` value (as text), ascending
    by ``order`` (null first, equal ones by digest), are its leaves; the trees' roots,
    ordered by ``tree`` (null first, then bytewise), are the leaves of the whole. A lone
    leaf is its tree's root, and a lone tree's root the whole's.

    All columns stay, whatever their names; ``subroot``, ``root``, ``proof`` (digests
    beside the way to the root, joined) and ``path`` (see ``sweep_back``) are added and
    replace columns of these names. Equal rows are leaves of their own. An empty table
    gives an empty one.
    """
    own = [c for c in leaves.columns if c not in ("subroot", "root", "proof", "path")]
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(own)]
    named = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    # The number is stored with the row: equal rows keep their places when a task is repeated.
    rows = materialize(leaves.select(*kept, named.alias("tree"), F.col(leaf).alias("digest"),
                                     F.monotonically_increasing_id().alias("tie")), "leaves")
    nodes = _placed(rows, [F.col(f"c{own.index(order)}").asc(), F.col("digest").asc(), F.col("tie").asc()])
    strata = _strata(nodes, stratum)
    subroots = strata[-1].select("tree", "digest") if len(strata) > 1 else nodes.select("tree", "digest")
    # The whole tree, whose leaves are the subroots.
    whole = _placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), [F.col("name").asc()])
    above = _strata(whole, stratum)
    root = above[-1].select("digest").first()
    tops = whole.limit(0).select("tree", "pos", F.lit("").alias("proof"), F.lit("").alias("path"))
    tops = above[-1].select("tree", "pos", F.lit("").alias("proof"), F.lit("").alias("path")) if root else tops
    named_tops = materialize(_proofs(above, tops, stratum).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "digest", "proof", "path"), "subroot-proofs")
    proved = _proofs(strata, named_tops, stratum)
    out = proved.join(named_tops.select("tree", F.col("digest").alias("subroot")), "tree")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "subroot",
                      F.lit(root["digest"] if root else None).cast("string").alias("root"), "proof", "path")


def folded_root(leaf: Column, proof: Column, path: Column) -> Column:
    """The root that each leaf gives with its proof; null if any of them is null."""
    @F.pandas_udf("string")
    def run(leaf: pd.Series, proof: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None or c is None else fold(a, b, c)
                          for a, b, c in zip(leaf, proof, path, strict=True)], dtype=object)
    return run(leaf, proof, path)
