import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedtab.llm import weak_quality as wq

SF = "/root/testdata/sf0.01"


def test_votes(spark):
    prose = "The cat and the dog went to the house of a friend, and it was late in the day when they came by. "
    rows = [(1, prose * 2), (2, "Ab### cd$$$ " * 30), (3, "THIS IS LOUD! " * 20), (4, "go " * 50), (5, None), (6, ""), (7, "short.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: dict(zip(wq.LABELLERS, r.v, strict=True)) for r in docs.select("doc_id", wq.votes("text").alias("v")).collect()}
    assert min(got[1].values()) >= 0 and got[1]["function_words"] == 1
    assert got[2]["symbols"] == -1 and got[3]["capitals"] == -1 and got[3]["exclamations"] == -1
    assert got[4]["neighbours"] == -1 and got[4]["variety"] == -1
    assert set(got[5].values()) == set(got[6].values()) == {0} and got[7]["symbols"] == 1


def test_expectation_maximisation_recovers_accuracies():
    rng = random.Random(1)
    counts = {}
    for _ in range(30000):
        good = rng.random() < 0.85
        v = tuple(0 if rng.random() < 0.2 else (1 if good == (rng.random() < a) else -1) for a in (0.97, 0.95, 0.9, 0.93))
        counts[v] = counts.get(v, 0) + 1
    post, accuracies = wq.estimate(counts)
    assert np.allclose(accuracies, (0.97, 0.95, 0.9, 0.93), atol=0.03)
    assert post[1, 1, 1, 1] > 0.95 and post[-1, -1, -1, -1] < 0.05
    assert wq.estimate({}) == ({}, [])


def test_query_keeps_good_and_rejects_junk(spark):
    from fedtab.llm.queries import llm_queries
    out = llm_queries()["op6_weak_quality"](spark, SF)
    assert out.count() == 1000
    both = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, junk = ([r.kept for r in both if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.1 * len(junk)


def plain_votes(text):
    """The labellers by plain Python."""
    import re
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    cut = lambda p: len(t) - len(re.sub(p, "", t))
    upper, letters = sum(c.isupper() for c in t), sum(c.isalpha() for c in t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = len(lines) - len(set(lines))
    function = sum(x.lower() in wq.FUNCTION_WORDS.split() for x in w)
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    enough = n >= wq.ENOUGH
    return (vote(cut(r"[#*$%&|<>]") < 0.02 * n, cut(r"[#*$%&|<>]") > 0.15 * n) if n else 0,
            vote(upper < 0.1 * max(letters, 1), upper > 0.4 * max(letters, 1)) if enough else 0,
            vote(len(set(w)) > 0.45 * n, len(set(w)) < 0.3 * n) if enough else 0,
            vote(function > 0.15 * n, function < 0.06 * n) if enough else 0,
            vote(again == 0, 10 * again > 6 * len(lines)) if len(lines) > 4 else 0,
            vote(t.count("!") < 0.02 * n, t.count("!") > 0.2 * n) if enough else 0,
            vote(sum(x == y for x, y in zip(w, w[1:], strict=False)) < 0.02 * n,
                 sum(x == y for x, y in zip(w, w[1:], strict=False)) > 0.15 * n) if enough else 0)


def plain_posteriors(votes, belief=5.0, rounds=50):
    """Expectation-maximisation text by text, not over counts of patterns."""
    votes = np.array(votes)
    post = np.where(votes.min(1) < 0, 0.05, 0.95)
    for _ in range(rounds):
        prior = (1 + post.sum()) / (2 + len(post))
        z = np.full(len(post), np.log(prior / (1 - prior)))
        for i in range(votes.shape[1]):
            p = {}
            for side, w in ((True, post), (False, 1 - post)):
                right, wrong = (belief * (3 if side else 1), belief * (1 if side else 3))
                up, down = right + w[votes[:, i] == 1].sum(), wrong + w[votes[:, i] == -1].sum()
                p[side] = up / (up + down)
            z += np.where(votes[:, i] == 1, np.log(p[True] / p[False]),
                          np.where(votes[:, i] == -1, np.log((1 - p[True]) / (1 - p[False])), 0.0))
        post = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    right = [np.where(votes[:, i] > 0, post, 1 - post)[votes[:, i] != 0].mean() if votes[:, i].any() else 0.5
             for i in range(votes.shape[1])]
    return post, right


def test_fit_and_scores_equal_a_plain_computation(spark):
    """Votes, expectation-maximisation and the slope of the training written out plainly; no function of the operator."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
    rows = docs.select("doc_id", "text", wq._votes_of(docs, "text", "lang").alias("v")).orderBy("doc_id").collect()
    votes = [plain_votes(r.text) for r in rows]
    assert [tuple(r.v) for r in rows] == votes
    post, accuracies = plain_posteriors(votes)
    got = wq.fit(docs, sample=10 ** 9)  # all texts
    assert np.allclose(got.accuracies, accuracies, atol=1e-9)
    counts = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    operator, _ = wq.estimate(dict(sorted(counts.items())))
    assert np.allclose([operator[v] for v in votes], post, atol=1e-9)
    # The scorer separates what the posteriors separate, and its score is the plain sum of its weights.
    scores = {r.doc_id: r.score for r in wq.score(docs, got).collect()}
    sure = [(scores[r.doc_id] > 0.5) == (p > 0.5) for r, p in zip(rows, post, strict=True) if abs(p - 0.5) > 0.4]
    assert np.mean(sure) > 0.98
    from zlib import crc32
    for r in rows:
        w = r.text.split()
        tenth = 10 * len(set(w)) // len(w) if len(w) >= wq.ENOUGH else "few"
        z = got.bias + sum(got.words[crc32(x.lower().encode()) % wq.WORD_BUCKETS] + got.shapes[crc32(wq._shape(x).encode()) % wq.SHAPE_BUCKETS]
                           for x in w) / max(len(w), 1) + got.shapes[crc32(f"variety {tenth}".encode()) % wq.SHAPE_BUCKETS]
        assert abs(scores[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -60, 60)))) < 1e-9
    docs.unpersist()


def test_odd_rows_and_columns(spark):
    rows = [(1, None, 1.0), (2, "", 2.0), (None, "a b", 3.0), (4, "x" * 100000, 4.0), (5, "same", 5.0), (5, "same", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("_score", F.lit("c"))
    out = wq.judge(docs).collect()
    assert len(out) == 6 and len({r.score for r in out if r.doc_id == 5}) == 1
    kept = wq.keep_good(docs)
    assert kept.columns == docs.columns and {r["_score"] for r in kept.collect()} <= {"c"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert wq.judge(docs).collect() == [] and wq.keep_good(docs).collect() == []


@pytest.mark.parametrize("share", [0.02, 0.2])
def test_clean_texts_of_a_fifth_language_stay(spark, share):
    rng = random.Random(5)
    function = "il di che e la per un in non una sono con si da come io ma le del ha".split()
    other = ["".join(rng.choice(["ba", "ce", "ri", "to", "lu", "na", "sso", "gli"]) for _ in range(rng.randint(2, 4))) for _ in range(600)]

    def sentence():
        return " ".join(rng.choice(function if rng.random() < 0.45 else other) for _ in range(rng.randint(8, 14))).capitalize() + "."
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    n = int(given.count() * share / (1 - share))
    more = [(10 ** 9 + i, " ".join(sentence() for _ in range(6)), "it") for i in range(n)]
    docs = given.unionByName(spark.createDataFrame(more, given.schema))
    kept = {r.doc_id for r in wq.keep_good(docs).collect()}
    assert sum(r[0] in kept for r in more) >= 0.95 * n
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, junk = ([r.doc_id in kept for r in labels if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_fit_leaves_the_words_of_its_texts_to_the_tasks(spark):
    """The driver gets a text's buckets; what it makes of them in a step does not grow with the sample."""
    import tracemalloc
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(400)), lambda x: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", x), F.lit(5000)).cast("string"))), " ").alias("text"))
    tracemalloc.start()
    try:
        scorer = wq.fit(docs, sample=10 ** 9)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.abs(scorer.words).max() > 0 and most < 60e6


def test_pieces_of_the_fit_do_not_change_it(spark, monkeypatch):
    texts = [None, "", *(f"{'a b ' * i}x{i} Y{i}! z" for i in range(60))]
    given = *wq._cells(texts, wq._Buckets()), np.linspace(0, 1, len(texts))
    whole = wq.train(*given)
    monkeypatch.setattr(wq, "PIECE", 7)
    cut = wq.train(*given)
    assert np.array_equal(whole.words, cut.words) and np.array_equal(whole.shapes, cut.shapes) and whole.bias == cut.bias
