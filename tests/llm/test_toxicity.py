import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from fedtab.llm.queries import llm_queries
from fedtab.llm.toxicity import LISTS, VOTERS, Classifier, estimate, features, fit, score, train, votes

COLUMNS = "doc_id long, text string"
SF = "/root/testdata/sf0.1"


def fold(key):
    return crc32(str(key).encode()) % 3


def ranks(x):
    order = np.argsort(x, kind="stable")
    _, group, n = np.unique(x[order], return_inverse=True, return_counts=True)
    out = np.empty(len(x))
    out[order] = (np.cumsum(n) - (n - 1) / 2)[group]
    return out


def auc(score, truth):
    n1 = truth.sum()
    return (ranks(score)[truth].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(truth) - n1))


def test_held_out_texts_of_the_labelled_table(spark):
    out = llm_queries()["op13_toxicity"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (fold(r.doc_id) == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    truth = np.array([r.toxic == 1 for r in held])
    assert auc(np.array([r.score for r in held]), truth) > 0.97
    said = np.array([r.predicted == 1 for r in held])
    assert said[truth].mean() > 0.8 and said[~truth].mean() < 0.01


def corpus(n, seed=1):
    rng = random.Random(seed)
    clean, bad = [f"{a}{b}or" for a in "bcdfg" for b in "aeiou"], ["zorg", "quaxon", "quaxil", "blimf"]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(clean) for _ in range(rng.randint(5, 40))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(1, 3) if toxic else 0):
            t.insert(rng.randrange(len(t) + 1), rng.choice(bad))
        rows.append((i, " ".join(t)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return rows, labels


def scores(spark, rows, labels):
    docs = spark.createDataFrame(rows, COLUMNS)
    return score(docs, fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))


def test_learns_words_and_their_beginnings(spark):
    rows, labels = corpus(400)
    found = fit(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert found.score("babor quaxolot", {}) > 0.7 and found.score("zorg babor", {}) > 0.7  # "quaxolot" is in no text
    assert found.score("babor dodor", {}) < 0.1 and found.score(None, {}) == found.score("", {}) < 0.2
    assert found.score("babor " * 50_000 + "blimf", {}) > 0.7  # whole texts, however long


def test_labels_of_the_held_out_third_are_not_used(spark, tmp_path):
    rows, labels = corpus(200, seed=2)
    out = []
    for k, flip in enumerate((False, True)):
        home = tmp_path / str(k)
        spark.createDataFrame(rows, COLUMNS).write.parquet(str(home / "documents.parquet"))
        spark.createDataFrame([(i, 1 - y if flip and fold(i) == 1 else y) for i, y in labels], "doc_id long, toxic int").write.parquet(
            str(home / "labels.parquet"))
        out.append(sorted(map(tuple, llm_queries()["op13_toxicity"](spark, str(home)).collect())))
    assert out[0] == out[1]


def test_odd_rows_labels_and_columns(spark):
    rows, labels = corpus(150, seed=3)
    rows += [(None, "zorg babor"), (None, None), (500, None), (501, ""), (501, ""), (7, rows[7][1]), (502, "é" * 100_000)]
    labels += [(None, 1), (3, None), (labels[0][0], 1 - labels[0][1]), (9999, 1)]
    docs = spark.createDataFrame([(*r, 0.5, "k", 1) for r in rows], COLUMNS + ", score double, key string, toxic int")
    out = score(docs, fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text}) == 1


def test_without_labels_or_rows(spark):
    rows, _ = corpus(40, seed=4)
    out = scores(spark, rows, []).collect()
    assert len(out) == 40 and all(0 <= r.score <= 1 for r in out)
    assert scores(spark, [], [(1, 1)]).collect() == []
    empty = spark.createDataFrame([], COLUMNS)
    assert fit(empty, spark.createDataFrame([], "doc_id long, toxic int")).score("x", {}) == 0.5


def test_label_model_finds_accuracies_and_dependent_voters():
    """Votes drawn from a known model: voter 1 copies voter 0, the others are independent given the class."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    v = np.zeros((len(truth), len(VOTERS)), int)
    for i, (hit, slip) in enumerate([(0.8, 0.05), (0, 0), (0.6, 0.02), (0.7, 0.1)]):
        v[:, i] = rng.random(len(truth)) < np.where(truth, hit, slip)
    v[:, 1] = np.where(rng.random(len(truth)) < 0.9, v[:, 0], rng.random(len(truth)) < 0.3)
    labels = np.where(rng.random(len(truth)) < 0.1, truth.astype(int), -1)
    model, post = estimate(v, labels, np.ones(len(truth)))
    strongest = max(model.dependences, key=model.dependences.get)
    assert set(strongest) == {VOTERS[0], VOTERS[1]}
    assert abs(model.prior - 0.2) < 0.02 and abs(model.accuracies[VOTERS[2]] - (0.2 * 0.6 + 0.8 * 0.98)) < 0.02
    # The exact posterior under the model that drew the votes, on which voter 1 adds nothing to voter 0.
    z = np.full(len(truth), np.log(0.2 / 0.8))
    for i, (hit, slip) in ((0, (0.8, 0.05)), (2, (0.6, 0.02)), (3, (0.7, 0.1))):
        z += np.where(v[:, i] > 0, np.log(hit / slip), np.log((1 - hit) / (1 - slip)))
    free = labels < 0
    assert np.abs(post - 1 / (1 + np.exp(-z)))[free].max() < 0.08
    counted = np.unique(np.c_[v, labels], axis=0, return_counts=True)
    again, _ = estimate(counted[0][:, :-1], counted[0][:, -1], counted[1])
    assert abs(again.prior - model.prior) < 1e-6


def test_votes():
    lists = {"idiot": 0, "stupi-": LISTS, "clown": 1}
    said = dict(zip(VOTERS, votes("You IDIOT! stupider and stupidest things", lists, {})[0], strict=True))
    assert said == {v: 0 for v in VOTERS} | {"words_0": 1, "stems_0": 2, "together": 1, "addressed": 1}
    far = dict(zip(VOTERS, votes("clown" + " word" * 20 + " idiot", lists, {})[0], strict=True))
    assert far["together"] == 0 and far["words_0"] == far["words_1"] == 1 and far["addressed"] == 0
    assert dict(zip(VOTERS, votes("WHAT EVER SAID f*ck", {}, {})[0], strict=True)) == {v: 0 for v in VOTERS} | {"shouting": 1, "disguised": 1}
    assert votes("", lists, {}) == ([0] * len(VOTERS), 0)


def test_features_and_training():
    assert features({"abcdef", "abcdxy", "abc"}) == {"abcdef", "abcdxy", "abc", "abcd-", "abcde-", "abcdx-", "abcd--"}
    rows = [["a", "x"]] * 30 + [["b", "x"]] * 70
    weights, bias = train(rows, np.array([0.95] * 30 + [0.05] * 70), np.ones(100))
    p = lambda *f: 1 / (1 + np.exp(-bias - sum(weights.get(k, 0) for k in f)))
    assert abs(p("a", "x") - 0.95) < 0.03 and abs(p("b", "x") - 0.05) < 0.03 and "x" not in weights
    assert train([], np.zeros(0), np.zeros(0)) == ({}, 0.0)
    assert train([[], []], np.array([1.0, 0.0]), np.ones(2))[0] == {}
    assert Classifier({}, 0.0).score("anything", {}) == 0.5
