import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from fedtab.llm.merkle import fold, folded_root, leaf_digest, merkle_manifest, sweep_back, sweep_forward
from fedtab.llm.queries import llm_queries

COLUMNS = "doc_id long, source string, lang string, n_chars int, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Levels of a tree, by the definition."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest(*low[i:i + 3]) for i in range(0, len(low), 3)])
    return levels


def beside(levels, at):
    found = []
    for low in levels[:-1]:
        run = low[at // 3 * 3:at // 3 * 3 + 3]
        found.append((at % 3, run))
        at //= 3
    return found


def brute(rows):
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0], leaf_of(*r), r[4]) for r in rows if r[1] == s),
                        key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in sources}
    trees = {s: tree([x[1] for x in leaves[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        for i, (doc_id, leaf, text) in enumerate(leaves[s]):
            way = beside(trees[s], i) + beside(top, k)
            now = leaf
            if doc_id is not None and crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                r = next(r for r in rows if r[0] == doc_id and r[1] == s and leaf_of(*r) == leaf)
                now = leaf_of(*r[:4], text.replace("\n", ""))
            proof = ""
            for at, run in way:
                proof += "".join(run[:at] + run[at + 1:])
                now = digest(*run[:at], now, *run[at + 1:])
            out.append((doc_id, leaf, trees[s][-1][0], root, digest(proof), now, now == root))
    return sorted(out, key=str)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    rows = [(i * 7 % (n + 3), rng.choice([None, "", "a", "b", "é", "z"]) if i % 3 else "hot", rng.choice([None, "en"]),
             rng.choice([None, i]), rng.choice([None, "", f"x\n{i}", "ü\n\n", "plain"])) for i in range(n)]
    return [*rows, *rows[:2], *rows[:2], (None, "a", None, None, "q\nq"), (None, None, None, None, None)]


def merkle(docs, **how):
    leaves = docs.select("doc_id", "source", leaf_digest(docs.columns).alias("leaf"), F.when(
        F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest([*docs.columns[:4], F.regexp_replace("text", "\n", "")])).alias("t"))
    out = merkle_manifest(leaves, **how)
    return out.withColumn("folded", folded_root(F.coalesce("t", "leaf"), F.col("proof"), F.col("path")))


@pytest.mark.parametrize(("n", "stratum"), [(60, 8), (60, 1), (45, 2), (1, 8)])
def test_equals_brute_force_at_any_stratum(spark, n, stratum):
    rows = rows_of(n)
    out = merkle(spark.createDataFrame(rows, COLUMNS), stratum=stratum).collect()
    got = sorted([(r.doc_id, r.leaf, r.subroot, r.root, digest(r.proof), r.folded, r.folded == r.root) for r in out], key=str)
    assert got == brute(rows)


def test_query_equals_brute_force(spark, tmp_path):
    rows = rows_of(90, seed=3)
    spark.createDataFrame(rows, COLUMNS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = llm_queries()["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)


def test_one_row_is_its_own_root(spark):
    out = merkle(spark.createDataFrame([(1, "s", None, 3, "a b")], COLUMNS)).collect()
    assert [(r.leaf, r.proof, r.path) for r in out] == [(r.root, "", "") for r in out] and out[0].folded == out[0].root


def test_empty_table_and_clashing_columns(spark):
    empty = merkle(spark.createDataFrame([], COLUMNS))
    assert empty.collect() == []
    docs = spark.createDataFrame([(1, "s", "l1", "x", 4), (2, "s", "l2", "y", 5)],
                                 "doc_id long, source string, leaf string, root string, n int")
    more = docs.select("*", F.lit(7).alias("tree"), F.lit("k").alias("block"), F.lit(0).alias("pos"), F.lit(1).alias("digest"))
    out = merkle_manifest(more)
    assert out.columns == ["doc_id", "source", "leaf", "n", "tree", "block", "pos", "digest", "subroot", "root", "proof", "path"]
    assert {(r.doc_id, r.n, r.tree, r.block, r.proof) for r in out.collect()} == {(1, 4, 7, "k", "l2"), (2, 5, 7, "k", "l1")}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 28])
def test_sweeps_of_one_block(n):
    leaves = [digest(str(i)) for i in range(n)]
    levels = tree(leaves)
    nodes = sweep_forward(leaves, len(levels) - 1)
    assert nodes == levels
    for i, (proof, path) in enumerate(sweep_back(nodes, "", "")):
        assert fold(leaves[i], proof, path) == levels[-1][0]
        if path:
            assert fold(digest("no"), proof, path) != levels[-1][0]


def test_a_block_below_a_higher_stratum_goes_up_all_its_levels():
    leaves = [digest(str(i)) for i in range(4)]
    nodes = sweep_forward(leaves, 4)
    assert [len(x) for x in nodes] == [4, 2, 1, 1, 1] and nodes[3] == [digest(nodes[2][0])]
