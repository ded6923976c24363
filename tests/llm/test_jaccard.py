import random

import pytest
from pyspark.sql import functions as F

from fedtab.llm import jaccard
from fedtab.llm.common import connected_components
from fedtab.llm.jaccard import jaccard_components

COLUMNS = "doc_id long, text string"


def shingles(text, n=3):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=3, percent=90):
    sets = {k: shingles(t, n) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in sets.items():
        for other in {j for x in s for j in holders[x] if j < k}:
            o = sets[other]
            if 100 * len(s & o) >= percent * len(s | o):
                a, b = sorted((find(k), find(other)))
                root[b] = a
    return {k: (len(s), find(k)) for k, s in sets.items()}


def same(spark, rows, **how):
    out = jaccard_components(spark.createDataFrame(rows, COLUMNS), **how).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert len(out) == len(rows) and got == brute(rows, **how)


def corpus(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common = [word() for _ in range(80)]
    texts = []
    for _ in range(size):
        kind = rng.random()
        if kind < 0.5 or not texts:
            t = [word() for _ in range(rng.randint(0, 150))]
        elif kind < 0.85:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 4)):
                if t:
                    t[rng.randrange(len(t))] = word()
        else:
            t = common + [word() for _ in range(rng.randint(0, 30))]
        texts.append(t)
    return [(i, " ".join(t) if rng.random() < 0.9 else "\n".join(t).upper()) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    same(spark, corpus(seed, 250))


def test_other_parameters(spark):
    same(spark, corpus(3, 150), n=2, percent=70)


def test_large_lists_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_ROWS", 8)
    same(spark, corpus(4, 200), n=3, percent=80)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base[:20] + [f"y{i}{j}" for j in range(30)])) for i in range(30)]
    same(spark, rows)


@pytest.mark.parametrize("suffix", [2, 5])
def test_no_set_fits_the_pivot_of_its_list(spark, suffix):
    """Whichever of four documents is a list's pivot, two that are near copies are linked."""
    common = " ".join(f"w{i}" for i in range(1, 20))
    texts = [f"f{suffix} {common} g{suffix} a{suffix}", f"f{suffix} {common} g{suffix} b{suffix}",
             f"f{suffix} {common} u{suffix} v{suffix}", f"k{suffix} {common} g{suffix} l{suffix}"]
    same(spark, list(enumerate(texts, 1)))


def test_nulls_empty_short_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (6, "a b c"), (7, "a\x0bb\x0cc"), (9, "É é b"),
            (10, "é é b"), (11, " a b")]
    same(spark, rows)
    docs = spark.createDataFrame([(None, "a b c d", 1), (3, "a b c d", 1), (3, "a b c d", 1), (2, "q", 1), (5, "q", 1)],
                                 COLUMNS + ", n int")
    out = sorted(((r.doc_id, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert out == sorted([(None, None), (3, 3), (3, 3), (2, 2), (5, 2)], key=str)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], COLUMNS)).collect() == []


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component_id for r in connected_components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(200, 260)} | {5: 5}


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (3, "q r s t", "x"), (3, "q r s t", "x"), (3, "a b c d", "z"),
            (None, "a b c d", "n"), (None, "u v w x y", "n"), (None, "u v w x y", "n"), (5, None, "x"), (6, "", "x"), (5, None, "x"),
            (None, None, "m"), (None, "", "m"), (None, " ", "m")]
    docs = spark.createDataFrame(rows, COLUMNS + ", n string").withColumn("_one_key", F.lit(1)).withColumn("k", F.lit(2))
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r)[:3] for r in out.collect()), key=str) == sorted(
        [(1, "a b c d", "x"), (3, "q r s t", "x"), (None, "u v w x y", "n"), (5, None, "x"), (6, "", "x"),
         (None, None, "m"), (None, "", "m"), (None, " ", "m")], key=str)


def test_near_copies_without_keys(spark):
    """One row of each group stays among rows without keys, too, and a row with a key before them."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"{base} x{i}") for i in range(5)] + [(None, f"z {base} v"), (9, f"{base} y"), (None, "other words here")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.doc_id) == [(9, f"{base} y")] and len(out) == 2


def test_near_copies_are_not_listed_in_all_pairs(spark, monkeypatch):
    """A quarter of a group links with all of it, the others with that quarter only: few pairs are left after the pivots."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(182)]
    rows = []
    for i in range(200):
        t = list(base)
        for k, at in enumerate(rng.sample(range(5, 175, 6), 1 if i % 4 == 0 else 2)):
            t[at] = f"x{i}y{k}"
        rows.append((i, " ".join(t)))
    left, found = [], jaccard._pairs_left

    def counted(*given):
        out = found(*given)
        left.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "_pairs_left", counted)
    same(spark, rows)
    assert sum(left) <= 5 * len(rows)


def test_map_of_keys_leaves_the_join_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BITS", 1 << 15)
    monkeypatch.setattr(jaccard, "MAP_ROW", 1 << 15)
    rows = spark.range(-30000, 30000).select(F.col("id").alias("key"), F.lit("t").alias("text"))
    wanted = rows.where("key % 7 = 0").select("key")
    assert sorted(r.key for r in jaccard._among(rows, "key", wanted.union(wanted)).collect()) == [k for k in range(-30000, 30000) if k % 7 == 0]
    assert jaccard._among(rows, "key", wanted.limit(0)).collect() == []
