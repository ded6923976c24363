"""Low-rank local training against plain NumPy, micro-batch by micro-batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedtab.operators import lowrank

DIM, CLASSES, RATE, MU = 6, 3, 0.4, 0.1
TRAINS = {("standard_lora", 1): "abh", ("ffa_lora", 1): "bh", ("rolora", 1): "bh", ("rolora", 2): "ah"}


def brute(rows, a, b, h, trains, batches, drop_tail, accumulate=4):
    """One client's epoch: ``rows`` = (x, y) in order; one update per ``accumulate`` micro-batches."""
    t = {"a": a.copy(), "b": b.copy(), "h": h.copy()}
    g0, losses, steps = {k: v.copy() for k, v in t.items()}, [], 0
    n = len(rows)
    parts = [[r for i, r in enumerate(rows) if i * min(batches, n) // n == m] for m in range(min(batches, n))]
    for s in range(0, len(parts), accumulate):
        grad = {k: np.zeros_like(v) for k, v in t.items()}
        for part in parts[s:s + accumulate]:
            loss = MU / 2 * sum(((t[k] - g0[k]) ** 2).sum() for k in trains)
            for x, y in part:
                u = t["a"] @ x
                hid = x + t["b"].T @ u
                z = t["h"] @ hid
                p = np.exp(z - z.max())
                p /= p.sum()
                loss += -np.log(p[y]) / len(part)
                off = p - np.eye(CLASSES)[y]
                q = t["h"].T @ off
                grad["h"] += np.outer(off, hid) / len(part) / accumulate
                grad["b"] += np.outer(u, q) / len(part) / accumulate
                grad["a"] += np.outer(t["b"] @ q, x) / len(part) / accumulate
            for k in trains:
                grad[k] += MU * (t[k] - g0[k]) / accumulate
            losses.append(loss)
        if not (drop_tail and len(parts[s:s + accumulate]) < accumulate):
            steps += 1
            for k in trains:
                t[k] = t[k] - RATE * grad[k]
    return t, float(np.mean(losses)), steps


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = [(c, pos, [float(v) for v in rng.normal(size=DIM)], int(rng.integers(CLASSES)))
            for c, n in ((0, 1), (1, 3), (2, 23), (3, 40)) for pos in range(n)]
    b = rng.normal(size=(4, DIM)) * 0.3
    return rows, b, spark.createDataFrame(rows, "client_id int, pos long, x array<double>, y int")


@pytest.mark.parametrize("drop_tail", [False, True])
def test_equals_numpy(spark, data, drop_tail):
    rows, b0, df = data
    clients = spark.createDataFrame([(c, 2 if c < 2 else 4) for c in range(5)], "client_id int, rank int")  # client 4 has no rows
    start = lowrank.first_state(clients, CLASSES, DIM, seed=5).withColumn(
        "b", F.slice(F.array(*[F.array(*map(F.lit, map(float, r))) for r in b0]), 1, F.col("rank")))
    start = start.withColumn(
        "run", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(r).alias("round")) for m, r in TRAINS]))).select(
        "client_id", "rank", "a", "b", "h", "run.*")
    begin = {(r["client_id"], r["method"], r["round"]): r for r in start.collect()}
    keys = ["method", "round", "client_id"]
    out = lowrank.fit_factors(lowrank.in_batches(df, batches=10), start, 3, keys, rate=RATE, mu=MU, drop_tail=drop_tail).collect()
    assert len(out) == 5 * len(TRAINS)
    for r in out:
        mine = [(np.array(x), y) for c, _, x, y in rows if c == r["client_id"]]
        s = begin[r["client_id"], r["method"], r["round"]]
        first = [np.array(s[k]) for k in "abh"]
        if not mine:
            assert r["n_steps"] == r["n_rows"] == 0 and r["mean_loss"] is None and r["a"] == s["a"]
            continue
        want, loss, steps = brute(mine, *first, TRAINS[r["method"], r["round"]], 10, drop_tail)
        for k in "abh":
            assert np.allclose(np.array(r[k]), want[k], atol=1e-10), (k, r["client_id"], r["method"])
        assert r["mean_loss"] == pytest.approx(loss, abs=1e-10) and r["n_steps"] == steps and r["n_rows"] == len(mine)
        for k in set("abh") - set(TRAINS[r["method"], r["round"]]):
            assert r[k] == s[k]  # frozen
        moved = any(r[k] != s[k] for k in "abh")
        assert moved == (not drop_tail or len(mine) >= 4)  # T18: fewer rows than a step needs


def test_fixed_micro_batches_and_nan_rows(spark):
    rows = [(0, p, [float("nan") if p == 2 else 1.0, 0.5], p % 2) for p in range(10)]
    df = spark.createDataFrame(rows, "client_id int, pos long, x array<double>, y int")
    parts = {r["pos"]: (r["step"], r["whole"], r["share"]) for r in lowrank.in_batches(df, batch_rows=2, accumulate=2).collect()}
    assert [parts[p][0] for p in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert [parts[p][1] for p in range(10)] == [True] * 8 + [False] * 2 and parts[9][2] == 0.5
    start = lowrank.first_state(spark.createDataFrame([(0, 2, "ffa_lora", 1)], "client_id int, rank int, method string, round int"), 2, 2)
    out = lowrank.fit_factors(lowrank.in_batches(df, batch_rows=2, accumulate=2), start, 3, accumulate=2).first()
    assert out["n_nan"] >= 1 and out["n_rows"] == 10


def test_a_round_starts_from_the_cropped_global_state(spark):
    clients = spark.createDataFrame([(0, 2), (1, 4)], "client_id int, rank int")
    shared = lowrank.first_state(spark.createDataFrame([(4,)], "rank int"), CLASSES, DIM)
    got = {r["client_id"]: r for r in lowrank.cropped(lowrank.first_state(clients, CLASSES, DIM, seed=1), shared).collect()}
    whole = shared.first()
    assert got[0]["a"] == whole["a"][:2] and got[1]["a"] == whole["a"] and len(got[0]["b"]) == 2 and got[0]["h"] == whole["h"]
    # Clients share the table whatever their rank.
    own = {r["client_id"]: r for r in lowrank.first_state(clients, CLASSES, DIM).collect()}
    assert own[0]["a"] == own[1]["a"][:2]


def test_cells_of_the_factors(spark):
    start = lowrank.first_state(spark.createDataFrame([(0, 2)], "client_id int, rank int"), CLASSES, DIM)
    shape = {r["param"]: (r["i"], r["j"]) for r in lowrank.factor_cells(start).groupBy("param").agg(
        (F.max("i") + 1).alias("i"), (F.max("j") + 1).alias("j")).collect()}
    assert shape == {"layers.0.lora_A.default.weight": (2, DIM), "layers.0.lora_B.default.weight": (DIM, 2),
                     "layers.0.score.weight": (CLASSES, DIM)}
