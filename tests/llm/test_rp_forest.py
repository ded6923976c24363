import numpy as np
import pytest

from fedtab.llm import rp_forest as rp
from fedtab.llm.rp_forest import Forest, near_vectors


def brute(vectors, least=0.9):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    cos = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    near = cos >= least
    label = np.arange(len(ids))
    while True:
        new = np.where(near, label[None, :], len(ids)).min(1)
        if (new == label).all():
            break
        label = new
    return {i: (int(near[k].sum()) - 1, ids[label[k]]) for k, i in enumerate(ids)}


def clouds(seed, n, dim=16, noise=0.05, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    out = {}
    for i in range(n):
        v = centres[rng.integers(groups)] if rng.random() < 0.5 else rng.standard_normal(dim)
        out[i * 3] = (v + noise * rng.standard_normal(dim)).astype(np.float32).tolist()
    return out


def run(spark, vectors, kind="float", forest=None):
    df = spark.createDataFrame([(k, v, 1) for k, v in vectors.items()], f"vec_id long, embedding array<{kind}>, dim int")
    out = near_vectors(df, forest=forest).collect()
    assert len(out) == len(vectors) and all(
        r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


def test_one_leaf_is_exact(spark):
    vectors = clouds(1, 300)
    assert run(spark, vectors) == brute(vectors)


@pytest.mark.parametrize("sample", [16384, 300])
def test_many_leaves_and_passes_reach_the_recall(spark, sample):
    vectors = clouds(2, 1500)
    got = run(spark, vectors, forest=Forest(leaf=40, sample=sample, levels=10 if sample > 1000 else 2))
    want = brute(vectors)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_leaves_in_blocks(spark):
    vectors = clouds(3, 250)
    assert run(spark, vectors, forest=Forest(block=50)) == brute(vectors)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = {1: None, 2: [], 3: [0.0, 0.0], 4: [1.0, None], 5: [nan, 1.0], 6: [inf, 1.0], 7: [1.0, 0.0], 8: [1.0, 0.0],
           9: [2.0, 0.0], 10: [1.0, 0.0, 0.0], 11: [0.0, 1.0], None: [1.0, 0.0]}
    got = run(spark, odd, "double")
    assert got == {i: (0, i) for i in (1, 2, 3, 4, 5, 6, 10, 11)} | {i: (2, 7) for i in (7, 8, 9)} | {None: (0, None)}


def test_copies_and_equal_keys(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0]), (4, [0.0, 1.0])],
                               "vec_id long, embedding array<double>")
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert out == [(4, 1, 4), (5, 1, 4), (5, 1, 5), (6, 1, 5)]


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_group_of_near_vectors_larger_than_a_leaf(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((7500, 64))
    x[:5000] = x[0] / np.linalg.norm(x[0]) + 0.3 / 8 * rng.standard_normal((5000, 64))
    vectors = {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}
    unit = np.array(list(vectors.values()), float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = np.array([n for _, (n, _) in sorted(run(spark, vectors).items())])
    assert want[:5000].mean() > 2000 and (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_pairs_of_an_earlier_leaf_are_left_out():
    """What is compared is all that no earlier leaf holds whole, and little more; a dense group is compared once."""
    rng = np.random.default_rng(1)
    n = 300
    inside = rng.random((n, 6)) < np.array([0.97, 0.97, 0.9, 0.5, 0.2, 0.02])
    rows = np.arange(n)
    for one, two in ((rows, rows), (rows[:120], rows[120:])):
        compared = np.zeros((n, n), int)
        for a, b in rp._fresh(one, two, inside):
            compared[np.ix_(a, b)] += 1
        assert compared.max() <= 1
        held = (inside[:, None, :] & inside[None, :, :]).any(2)
        need = np.zeros((n, n), bool)
        need[np.ix_(one, two)] = True
        assert (compared[need & ~held] == 1).all()
        assert compared.sum() < 0.2 * need.sum()
    leaves = [np.array([3, 9, 12]), np.array([9, 20]), np.array([3, 9, 30]), np.array([40])]
    assert rp._earlier(leaves, 12).tolist() == [[True, True], [True, False], [True, True], [False, False]]
