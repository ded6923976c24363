"""Toxicity scores from weak supervision.

Many voters look at a text: lists of words and of word beginnings that labelled
toxic texts have and clean ones lack, and patterns (shouting, masked or stretched
words, listed words close together or spoken to somebody). Expectation-maximisation
over the counts of all vote patterns estimates how often each voter speaks up on
toxic and on clean texts and which voters depend on each other: a tree of the
strongest conditional dependences (Chow and Liu), in which a voter's share depends
on the class and on its neighbour's vote. The posteriors train a sparse linear
classifier on the words and word beginnings of a text, which scores every text.

Votes and pattern counts cover all texts to learn from; the lists and the
classifier are fitted on bounded samples (``LABELLED``, ``SAMPLE``, ``SAMPLE_WORDS``).
Samples are keys, broadcast to the texts, so no text is shuffled. What reaches the
driver: one row per vote pattern (at most 3^6 * 2^4 with 3 labels), the entries of
the lists, and the sampled texts' features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fedtab.llm.common import uniform
from fedtab.session import materialize

#: Expected number of labelled texts of each class behind the lists.
LABELLED = 20_000
#: Expected number of texts of each class, by posterior, on which the classifier is fitted, and of their distinct words.
SAMPLE, SAMPLE_WORDS = 4000, 600_000
#: Entries of all lists together; texts that have to have one; share of toxic ones among them.
ENTRIES, LEAST_TEXTS, LEAST_SHARE = 2000, 5, 0.8
#: Lengths of word beginnings.
STEMS = (4, 5, 6)
#: Word lists, and lists of beginnings; entries are dealt to them by hash.
LISTS = 3
VOTERS = (*(f"words_{i}" for i in range(LISTS)), *(f"stems_{i}" for i in range(LISTS)), "shouting", "disguised", "together", "addressed")
#: How many votes a voter has: silent, one entry, several; patterns are there or not.
LEVELS = (*[3] * (2 * LISTS), 2, 2, 2, 2)
#: Words between two entries that are close.
CLOSE = 8
ROUNDS, RETREE = 40, 10
#: Dependence (nats) below which two voters count as independent given the class.
LEAST_DEPENDENCE = 1e-4
#: Weight of the absolute values of the classifier's weights, of their squares once they are chosen, and passes over them.
SPARSITY, RIDGE, PASSES, LAST_PASSES = 2e-4, 3e-5, 30, 6
MEMO = 200_000
#: Who is spoken to (English, German, French, Spanish).
ADDRESS = frozenset("you your youre u ya du dich dir ihr euch sie tu te toi vous votre ton tú usted ustedes eres sois os".split())

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[^\W\d_]{4,}\b")
_DISGUISED = re.compile(r"[^\W\d_][*@#$]+[^\W\d_]|([^\W\d_])\1{3,}")


def features(words: set[str]) -> set[str]:
    """Words of a text, their beginnings (marked with a dash) and those that several words share (with two)."""
    stems = Counter(w[:k] + "-" for w in words for k in STEMS if len(w) > k)
    return words.union(stems, (s + "-" for s, n in stems.items() if n > 1))


def _entries_of(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def _list_of(entry: str) -> int:
    return crc32(entry.encode()) % LISTS + (LISTS if entry.endswith("-") else 0)


def votes(text: str, lists: dict[str, int], memo: dict[str, tuple[int, ...]]) -> tuple[list[int], int]:
    """Every voter's vote on a text and its number of distinct words. ``lists``: entry -> number of its list."""
    words = _WORD.findall(text.lower())
    hits: list[set[str]] = [set() for _ in range(2 * LISTS)]
    last, together, addressed, spoken = -CLOSE - 1, 0, 0, -CLOSE - 1
    distinct = set(words)
    found = set()
    for w in distinct:
        at = memo.get(w)
        if at is None:
            at = memo[w] = tuple({lists[e] for e in _entries_of(w) if e in lists})
        for k in at:
            hits[k].add(w)
            found.add(w)
    if found:
        for i, w in enumerate(words):
            if w in found:
                together |= i - last <= CLOSE
                addressed |= i - spoken <= CLOSE
                last = i
            elif w in ADDRESS:
                spoken = i
    long = _SHOUT.findall(text)
    loud = sum(map(str.isupper, long))
    return [*(min(len(h), 2) for h in hits), int(loud >= 3 and 10 * loud >= 3 * len(long)), int(_DISGUISED.search(text) is not None),
            int(together), int(addressed)], len(distinct)


# ------------------------------------------------------------------ label model

@dataclass
class LabelModel:
    """Prior, tree of voters (each one's neighbour nearer the root, or -1) and tables P(vote | class, neighbour's vote)."""

    prior: float = 0.5
    parents: list[int] = field(default_factory=lambda: [-1] * len(VOTERS))
    tables: list[np.ndarray] = field(default_factory=list)
    accuracies: dict[str, float] = field(default_factory=dict)
    dependences: dict[tuple[str, str], float] = field(default_factory=dict)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Likelihood that texts of these vote patterns are toxic."""
        z = np.full(len(patterns), math.log(self.prior / (1 - self.prior)))
        for i, (p, t) in enumerate(zip(self.parents, self.tables, strict=True)):
            given = patterns[:, p] if p >= 0 else np.zeros(len(patterns), int)
            z += np.log(t[1, given, patterns[:, i]] / t[0, given, patterns[:, i]])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def dependence(patterns: np.ndarray, weight: np.ndarray, i: int, j: int) -> float:
    """Mutual information of two voters given the class; ``weight``: (class, pattern)."""
    total, found = weight.sum(), 0.0
    for w in weight:
        joint = np.zeros((LEVELS[i], LEVELS[j]))
        np.add.at(joint, (patterns[:, i], patterns[:, j]), w)
        n = joint.sum()
        if n > 0:
            alone = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True) / n
            there = joint > 0
            found += float((joint[there] * np.log(joint[there] / alone[there])).sum())
    return found / max(total, 1e-9)


def tree(patterns: np.ndarray, weight: np.ndarray) -> tuple[list[int], dict[tuple[int, int], float]]:
    """Spanning tree of the strongest dependences: every voter's neighbour nearer the root, and the edges kept."""
    m = patterns.shape[1]
    strong = {(i, j): dependence(patterns, weight, i, j) for i in range(m) for j in range(i + 1, m)}
    parents, inside, kept = [-1] * m, {0}, {}
    while len(inside) < m:
        a, b = max(((i, j) for i in inside for j in range(m) if j not in inside),
                   key=lambda e: (strong[min(e), max(e)], -e[1], -e[0]))
        if strong[min(a, b), max(a, b)] >= LEAST_DEPENDENCE:
            parents[b] = a
            kept[a, b] = strong[min(a, b), max(a, b)]
        inside.add(b)
    return parents, kept


def estimate(patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    """The label model and every row's posterior, by expectation-maximisation.

    ``labels``: 1 toxic, 0 clean, -1 unknown. Known ones are kept, which also says which class is which; unknown
    ones start from what the known ones say, or without any from whether a voter speaks.
    """
    model = LabelModel()
    known = labels >= 0
    counts = counts.astype(float)
    if (labels == 1).any():
        post, active = np.where(known, labels, 0.5).astype(float), known
    else:
        post, active = np.where(patterns.max(1, initial=0) > 0, 0.9, 0.1), np.ones(len(labels), bool)
    post[labels == 0] = 0.0
    for turn in range(ROUNDS):
        use = counts * active
        weight = np.stack([use * (1 - post), use * post])
        if turn % RETREE == 0:
            model.parents, kept = tree(patterns, weight)
        model.prior = float((1 + weight[1].sum()) / (2 + weight.sum()))
        model.tables = []
        for i, p in enumerate(model.parents):
            t = np.full((2, LEVELS[p] if p >= 0 else 1, LEVELS[i]), 0.5)
            given = patterns[:, p] if p >= 0 else np.zeros(len(patterns), int)
            for c in (0, 1):
                np.add.at(t[c], (given, patterns[:, i]), weight[c])
            model.tables.append(t / t.sum(2, keepdims=True))
        new = np.where(known, labels, model.posterior(patterns))
        if active.all() and np.abs(new - post).max(initial=0.0) < 1e-6 and turn % RETREE:
            break
        post, active = new, np.ones(len(labels), bool)
    right = [(counts * np.where(patterns[:, i] > 0, post, 1 - post)).sum() / max(counts.sum(), 1) for i in range(len(VOTERS))]
    model.accuracies = dict(zip(VOTERS, map(float, right), strict=True))
    model.dependences = {(VOTERS[i], VOTERS[j]): v for (i, j), v in kept.items()}
    return model, post


# ------------------------------------------------------------------ classifier

@dataclass(frozen=True)
class Classifier:
    """Weights of words and word beginnings, all others 0, and the label model it has learned from."""

    weights: dict[str, float]
    bias: float
    model: LabelModel | None = None

    def score(self, text: str | None, memo: dict[str, tuple[str, ...]]) -> float:
        """Likelihood that a text is toxic; a null text counts as empty."""
        found: Counter[str] = Counter()
        for w in set(_WORD.findall(text.lower())) if text else ():
            known = memo.get(w)
            if known is None:
                known = tuple(e for e in _entries_of(w) if e in self.weights or e + "-" in self.weights)
                if len(w) < 64:
                    memo[w] = known
            if known:
                found.update(known)
        z = self.bias
        for e, n in sorted(found.items()):
            z += self.weights.get(e, 0.0)
            if n > 1:
                z += self.weights.get(e + "-", 0.0)
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, z))))


def train(rows: list[list[str]], target: np.ndarray, weight: np.ndarray, sparsity: float = SPARSITY,
          ridge: float = RIDGE) -> tuple[dict[str, float], float]:
    """Logistic regression of soft labels on the presence of features: weights of the chosen ones, and the bias.

    Newton steps, one feature at a time, with a penalty on absolute weights choose the features (one whose slope at
    the start is below the penalty is left out); then the chosen ones are fitted again with a penalty on squares alone.
    """
    weight = weight / max(weight.sum(), 1e-9)
    share = float(np.clip((weight * target).sum(), 1e-6, 1 - 1e-6)) if len(rows) else 0.5
    bias = math.log(share / (1 - share))
    index: dict[str, int] = {}
    at = np.array([index.setdefault(f, len(index)) for r in rows for f in r], np.int64)
    if not len(at):
        return {}, bias
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slope, texts = np.bincount(at, (weight * (share - target))[doc], len(index)), np.bincount(at, minlength=len(index))
    use = np.flatnonzero((np.abs(slope) > sparsity) & (texts >= LEAST_TEXTS))
    use = use[np.lexsort((use, -np.abs(slope[use])))]
    by, ends = doc[np.argsort(at, kind="stable")], np.cumsum(texts)
    members = [by[ends[i] - texts[i]:ends[i]] for i in use]
    theta, z = np.zeros(len(use)), np.full(len(rows), bias)

    def stepped(j: int, absolute: float, square: float) -> float:
        m = members[j]
        p = 1 / (1 + np.exp(-np.clip(z[m], -60, 60)))
        g = (weight[m] * (p - target[m])).sum() + square * theta[j]
        h = max((weight[m] * p * (1 - p)).sum(), 1e-7) + square
        new = theta[j] - g / h
        d = float(np.clip(math.copysign(max(abs(new) - absolute / h, 0.0), new) - theta[j], -1, 1))
        theta[j] += d
        z[m] += d
        return abs(d)

    for t in range(PASSES + LAST_PASSES):
        last = t >= PASSES
        some = np.flatnonzero(theta) if last or t % 5 else range(len(use))
        for j in some:
            stepped(j, 0.0 if last else sparsity, ridge if last else 0.0)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        d = float(np.clip((weight * (target - p)).sum() / max((weight * p * (1 - p)).sum(), 1e-7), -1, 1))
        z += d
        bias += d
    names = list(index)
    return {names[i]: float(v) for i, v in zip(use, theta, strict=True) if v}, bias


# ------------------------------------------------------------------ on Spark

def toxic_lists(texts: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict[str, int]:
    """Entry -> its list: words and beginnings that labelled toxic texts have and clean ones lack.

    ``texts``: ``(key, text)``; ``labels``: ``(key, toxic)``, one row a key. An expected ``labelled`` keys of each class are drawn and
    broadcast to the texts; the counts of entries are combined before they are shuffled.
    """
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return {}
    rate = {c: min(1.0, labelled / max(n.get(c, 0), 1)) for c in (0, 1)}
    drawn = labels.where(uniform(F.col("key"), "toxic-lists") < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))

    def stems(k: int) -> Column:
        return F.transform(F.filter("w", lambda x: F.char_length(x) > k), lambda x: F.concat(F.substring(x, 1, k), F.lit("-")))
    rows = (texts.join(F.broadcast(drawn), "key").select("toxic", words.alias("w"))
            .select("toxic", F.explode(F.array_distinct(F.concat("w", *map(stems, STEMS)))).alias("entry")))
    toxic, clean = F.sum(F.col("toxic")) / F.lit(rate[1]), F.sum(1 - F.col("toxic")) / F.lit(rate[0])
    found = (rows.groupBy("entry").agg(toxic.alias("toxic"), clean.alias("clean"), F.sum("toxic").alias("seen"))
             .where((F.col("seen") >= LEAST_TEXTS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean") + 1)))
             .orderBy(F.desc(F.col("toxic") * F.log(F.col("toxic") / (F.col("clean") + 1) + 1)), "entry").limit(ENTRIES))
    return {r["entry"]: _list_of(r["entry"]) for r in found.collect()}


def _voted(texts: DataFrame, lists: dict[str, int]) -> DataFrame:
    """``(key, text_hash, pattern, n_words)`` of every row."""
    shared = texts.sparkSession.sparkContext.broadcast(lists)
    schema = "key long, text_hash long, pattern array<int>, n_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            patterns, sizes = [], []
            for i in range(0, batch.num_rows, 128):
                if len(memo) > MEMO:
                    memo.clear()
                for t in batch.column(2).slice(i, 128).to_pylist():
                    v, n = votes(t or "", shared.value, memo)
                    patterns.append(v)
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(patterns, pa.list_(pa.int32())),
                                              pa.array(sizes, pa.int64())], ["key", "text_hash", "pattern", "n_words"])
    return texts.select("key", F.xxhash64("text"), "text").mapInArrow(run, schema)


def _featured(docs: DataFrame) -> DataFrame:
    """``(key, text_hash, found)``: the features of ``(key, text_hash, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(features(set(_WORD.findall((t.as_py() or "").lower())))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.string()))],
                                             ["key", "text_hash", "found"])
    return docs.mapInArrow(run, "key long, text_hash long, found array<string>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Classifier:
    """Learn from the texts of ``docs`` and the labels ``(key, label)`` of some of them.

    Keys with several labels count as toxic if one says so; null keys and labels are ignored, null texts teach
    nothing. Without a toxic label the lists are empty and the patterns alone speak; an empty table gives a
    classifier that scores 0.5.
    """
    known = materialize(labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
                        .groupBy(F.col(key).cast("long").alias("key")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic")), "toxic-labels")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    lists = toxic_lists(texts, known)
    voted = materialize(_voted(texts, lists).join(known, "key", "left")
                        .withColumn("toxic", F.coalesce("toxic", F.lit(-1))), "toxic-votes")
    seen = (voted.groupBy("pattern", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")).collect())
    seen.sort(key=lambda r: (r["pattern"], r["toxic"]))
    if not seen:
        return Classifier({}, 0.0, LabelModel())
    patterns, marks = np.array([r["pattern"] for r in seen]), np.array([r["toxic"] for r in seen])
    counts, sizes = np.array([r["n"] for r in seen], float), np.array([r["words"] for r in seen], float)
    model, post = estimate(patterns, marks, counts)
    # One stratum per likely class, each drawn at a rate that bounds its expected rows and words.
    rate = {}
    for c in (0, 1):
        of = (post >= 0.5) == c
        rate[c] = float(min(1.0, sample / max(counts[of].sum(), 1), sample_words / 2 / max(sizes[of].sum(), 1)))
    likely = docs.sparkSession.createDataFrame(
        [(r["pattern"], r["toxic"], float(p), rate[int(p >= 0.5)]) for r, p in zip(seen, post, strict=True)],
        "pattern array<int>, toxic int, post double, rate double")
    drawn = (voted.join(F.broadcast(likely), ["pattern", "toxic"])
             .where(uniform(F.concat_ws(":", F.col("key").cast("string"), F.col("text_hash").cast("string")), "toxic-sample") < F.col("rate"))
             .groupBy("key", "text_hash").agg(F.first("post").alias("post"), F.sum(1 / F.col("rate")).alias("weight")))
    drawn = materialize(drawn, "toxic-sample")
    # One text for each drawn (key, hash): equal rows weigh as many.
    same = (texts.select("key", F.xxhash64("text").alias("text_hash"), "text")
            .join(F.broadcast(drawn.select(F.col("key").alias("k"), F.col("text_hash").alias("h"))),
                  F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left_semi"))
    found = _featured(same).groupBy("key", "text_hash").agg(F.max("found").alias("found"))
    rows = found.join(drawn, found["key"].eqNullSafe(drawn["key"]) & (found["text_hash"] == drawn["text_hash"])).select(
        found["key"], found["text_hash"], "found", "post", "weight").collect()
    rows.sort(key=lambda r: (r["key"] is None, r["key"] or 0, r["text_hash"]))
    weights, bias = train([r["found"] for r in rows], np.array([r["post"] for r in rows]), np.array([r["weight"] for r in rows]))
    return Classifier(weights, bias, model)


def score(docs: DataFrame, classifier: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """Add every whole text's score; all rows and columns stay (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    rows = docs.drop(out) if out != text else docs
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = []
            for i in range(0, batch.num_rows, 128):
                if len(memo) > MEMO:
                    memo.clear()
                scores += [shared.value.score(t, memo) for t in batch.column(at).slice(i, 128).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, out])
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, DoubleType())]))


def predicted(scores: Column, least: float = 0.7) -> Column:
    return (scores >= least).cast("int")
