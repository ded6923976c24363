"""Quality classifier trained on weak labels.

Heuristic labellers vote on every document. Expectation-maximisation over the
counts of all vote patterns estimates each labeller's accuracy and the
likelihood that a pattern is good text; those likelihoods train a linear scorer
on hashed words and word shapes, and the scorer judges every document.

Votes and pattern counts are DataFrame functions over all documents; one row per
vote pattern reaches the driver. The scorer is fitted on a bounded sample, whose
texts tasks turn into buckets, and applied in Spark tasks, batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from fedtab.llm.common import WORD, pieces, uniform, words
from fedtab.llm.quality_rules import let
from fedtab.session import materialize, release

#: Expected number of sampled texts on which the scorer is fitted and of their characters, the bounds of the fit.
SAMPLE, SAMPLE_CHARS = 4000, 24_000_000
#: Hash buckets of words and of word shapes.
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 14, 1 << 12
STEPS, RATE, PENALTY, ROUNDS = 150, 0.5, 3e-6, 50
#: Prior votes behind the belief that a labeller is right more often than not.
BELIEF = 5.0
#: A document whose score is below this is rejected.
LEAST = 0.5
#: Words below which the labellers of shares do not vote.
ENOUGH = 20
MEMO = 100_000
#: Buckets of texts that a step of the fit takes at a time.
PIECE = 1 << 17
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = ("the of and to in is that for it with as was on be by this are from at or an der die das und den von zu mit "
                  "sich des auf nicht ein eine dem le la les des et en un une du que qui dans pour par de el los y se las")
FUNCTION_LANGS = ("en", "de", "fr", "es")
#: For any other language, so many of its most frequent words take their place if they make up this share of its words
#: and it has so many.
LISTED, FITS, LISTED_WORDS = 40, 0.15, 1000
LABELLERS = ("symbols", "capitals", "variety", "function_words", "lines", "exclamations", "neighbours")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def frequent_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Most frequent words of every language that ``FUNCTION_WORDS`` does not cover, where they fit its texts."""
    other = docs.where(F.col(lang).isNotNull() & ~F.col(lang).isin(*FUNCTION_LANGS) & F.col(text).isNotNull())
    counted = (other.select(F.col(lang).alias("lang"), F.explode(words(F.lower(F.col(text)))).alias("word"))
               .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    counted = materialize(counted, "frequent-words")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    found: dict[str, dict[str, int]] = {}
    for r in counted.withColumn("rank", first).where(F.col("rank") <= LISTED).collect():
        found.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return {k: sorted(v) for k, v in sorted(found.items())
            if totals[k] >= LISTED_WORDS and sum(v.values()) >= FITS * totals[k]}


def _votes_of(docs: DataFrame, text: str, lang: str) -> Column:
    """Votes of the rows of ``docs`` by the function words of each row's language, as far as they are known."""
    if lang not in docs.columns:
        return votes(text, F.lit(False))
    known, own = F.coalesce(F.col(lang).isin(*FUNCTION_LANGS), F.lit(False)), None
    listed = frequent_words(docs, text, lang)
    if listed:
        lists = F.create_map(*[x for k, v in listed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        own = F.when(F.col(lang).isNotNull(), F.try_element_at(lists, F.col(lang)))
    return votes(text, known, own)


def votes(text: str | Column, known: Column | None = None, own: Column | None = None) -> Column:
    """One vote per labeller: 1 good, -1 bad, 0 none. A null or empty text gets none.

    ``known``: whether ``FUNCTION_WORDS`` cover the text's language (by default they do). ``own``: the function words
    of its language if they do not. Where neither is given, few function words say nothing.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def of(x: Column) -> Column:
        cut = lambda p: F.char_length(x) - F.char_length(F.regexp_replace(x, p, ""))
        lines = F.filter(F.split(x, "\n"), lambda v: v.rlike(WORD))

        def spoken(m: Column, function: Column) -> Column:
            if known is None:
                return _vote(function > 0.15, function < 0.06)
            share = F.when(known, function) if own is None else F.when(known, function).otherwise(m["own"] / m["n"])
            return F.when((function > 0.15) | (share > 0.15), 1).when(share < 0.06, -1).otherwise(0)

        def judge(m: Column) -> Column:
            n, enough = m["n"], m["n"] >= ENOUGH
            symbols, function = m["symbols"] / n, m["function"] / n
            capital = m["upper"] / F.greatest(m["letters"], F.lit(1))
            return F.array(
                F.when(n > 0, _vote(symbols < 0.02, symbols > 0.15)).otherwise(0),
                F.when(enough, _vote(capital < 0.1, capital > 0.4)).otherwise(0),
                F.when(enough, _vote(m["distinct"] / n > 0.45, m["distinct"] / n < 0.3)).otherwise(0),
                F.when(enough, spoken(m, function)).otherwise(0),
                F.when(m["lines"] > 4, _vote(m["again"] == 0, 10 * m["again"] > 6 * m["lines"])).otherwise(0),
                F.when(enough, _vote(m["bangs"] < 0.02 * n, m["bangs"] > 0.2 * n)).otherwise(0),
                F.when(enough, _vote(m["same"] < 0.02 * n, m["same"] > 0.15 * n)).otherwise(0))
        function = r"(?<![^\x20\x09-\x0D])(?:" + "|".join(FUNCTION_WORDS.split()) + r")(?![^\x20\x09-\x0D])"
        counts = let(words(x), lambda w: let(lines, lambda v: F.struct(
            F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.size(v).alias("lines"),
            (F.size(v) - F.size(F.array_distinct(v))).alias("again"), cut(r"[#*$%&|<>]").alias("symbols"),
            cut(r"\p{Lu}").alias("upper"), cut(r"\p{L}").alias("letters"), cut("!").alias("bangs"),
            F.size(F.filter(w, lambda y, i: y == F.get(w, i - 1))).alias("same"),
            F.regexp_count(F.lower(x), F.lit(function)).alias("function"),
            *([] if own is None else [F.size(F.filter(w, lambda y: F.array_contains(own, F.lower(y)))).alias("own")]))))
        return let(counts, judge)
    return let(t, of)


def estimate(counts: dict[tuple[int, ...], int]) -> tuple[dict[tuple[int, ...], float], list[float]]:
    """Likelihood that each vote pattern is good text, and every labeller's accuracy, by expectation-maximisation.

    Two hidden classes; votes are independent given the class, and not voting
    says nothing. It starts from the belief that a text is bad if any labeller
    says so: each looks for another fault, so most faulty texts have one bad vote
    among several good ones, and a start from majorities would end with only the
    faults that several labellers see.
    """
    if not counts:
        return {}, []
    post = {p: 0.05 if min(p) < 0 else 0.95 for p in counts}
    width = len(next(iter(counts)))
    total = sum(counts.values())
    for _ in range(ROUNDS):
        prior = (1 + sum(c * post[p] for p, c in counts.items())) / (2 + total)
        table = {}
        for i in range(width):
            for good in (True, False):
                share = {v: BELIEF * (2 + v if good else 2 - v) for v in (-1, 1)}
                for p, c in counts.items():
                    if p[i]:
                        share[p[i]] += c * (post[p] if good else 1 - post[p])
                n = sum(share.values())
                table[i, good] = {v: s / n for v, s in share.items()}
        for p in counts:
            z = math.log(prior / (1 - prior))
            for i, v in enumerate(p):
                if v:
                    z += math.log(table[i, True][v] / table[i, False][v])
            post[p] = 1 / (1 + math.exp(-min(60.0, max(-60.0, z))))
    right = [sum(c * (post[p] if p[i] > 0 else 1 - post[p]) for p, c in counts.items() if p[i]) for i in range(width)]
    voted = [sum(c for p, c in counts.items() if p[i]) for i in range(width)]
    return post, [r / v if v else 0.5 for r, v in zip(right, voted, strict=True)]


def _shape(word: str) -> str:
    """Kinds of a word's characters, repeats left out: ``Abc!!`` -> ``Aa!``."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class _Buckets(dict):
    """Word -> its two buckets as one number."""

    def __missing__(self, word: str) -> int:
        value = (crc32(word.lower().encode()) % WORD_BUCKETS) * SHAPE_BUCKETS + crc32(_shape(word).encode()) % SHAPE_BUCKETS
        if len(word) < 64:
            self[word] = value
        return value


def _hashed(texts: list[str | None], memo: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and shape buckets of all words of the texts, the words of each text and its variety bucket."""
    flat, sizes, variety = [], [], []
    for t in texts:
        w = t.split() if t else ()
        flat += map(memo.__getitem__, w)
        sizes.append(len(w))
        tenth = 10 * len(set(w)) // len(w) if len(w) >= ENOUGH else "few"
        variety.append(crc32(f"variety {tenth}".encode()) % SHAPE_BUCKETS)
    at = np.array(flat, np.int64)
    return at // SHAPE_BUCKETS, at % SHAPE_BUCKETS, np.array(sizes, np.int64), np.array(variety, np.int64)


@dataclass(frozen=True)
class Scorer:
    """Weights of word buckets and of shape buckets, bias, and the labellers' estimated accuracies."""

    words: np.ndarray
    shapes: np.ndarray
    bias: float
    accuracies: tuple[float, ...]

    def score(self, texts: list[str | None], memo: _Buckets) -> np.ndarray:
        """Likelihood that each text is good."""
        w, s, sizes, variety = _hashed(texts, memo)
        sums = np.r_[0.0, np.cumsum(self.words[w] + self.shapes[s])]
        ends = np.cumsum(sizes)
        z = (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1) + self.shapes[variety] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _cells(texts: list[str | None], memo: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many buckets each text has, which ones (shapes after words) and their shares in its words; the variety's is 1."""
    w, s, sizes, variety = _hashed(texts, memo)
    doc = np.repeat(np.arange(len(texts)), sizes)
    share = 1 / np.maximum(sizes, 1)[doc]
    wide = WORD_BUCKETS + SHAPE_BUCKETS
    whole = np.arange(len(texts)) * wide + WORD_BUCKETS + variety
    cells, inverse = np.unique(np.r_[doc * wide + w, doc * wide + WORD_BUCKETS + s, whole], return_inverse=True)
    value = np.bincount(inverse, np.r_[share, share, np.ones(len(texts))], len(cells))
    return np.bincount(cells // wide, minlength=len(texts)), (cells % wide).astype(np.uint16), value


def _bucketed(drawn: DataFrame) -> DataFrame:
    """``(votes, at, value)`` of each row of ``(text, votes)``: its text's buckets and their shares, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets()
        for batch in pieces(batches, 128):
            if len(memo) > MEMO:
                memo.clear()
            n, at, value = _cells(batch.column(0).to_pylist(), memo)
            ends = np.cumsum(n)
            cut = lambda x: pa.array([x[e - k:e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(1), cut(at), cut(value)], ["votes", "at", "value"])
    rows = drawn.select("text", "votes")
    return rows.mapInArrow(run, StructType([rows.schema["votes"], StructField("at", BinaryType()), StructField("value", BinaryType())]))


def train(n: np.ndarray, at: np.ndarray, value: np.ndarray, target: np.ndarray, accuracies: tuple[float, ...] = ()) -> Scorer:
    """Logistic regression of soft labels on the shares of buckets in a text, by Adam steps; classes weigh the same.

    Text i has the next ``n[i]`` of the buckets ``at`` with their shares ``value``. Each step goes over them in pieces of
    whole texts, so that what it makes beside them is small.
    """
    if not len(n):
        return Scorer(np.zeros(WORD_BUCKETS), np.zeros(SHAPE_BUCKETS), 0.0, tuple(accuracies))
    wide = WORD_BUCKETS + SHAPE_BUCKETS
    ends = np.cumsum(n)
    texts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PIECE, ends[-1], PIECE)), len(n)])
    cells = np.r_[0, ends][texts]
    good = target.sum()
    weight = target / max(good, 1.0) + (1 - target) / max(len(target) - good, 1.0)
    theta, m, v = np.zeros(wide + 1), np.zeros(wide + 1), np.zeros(wide + 1)
    for t in range(1, STEPS + 1):
        g, off = np.zeros(wide + 1), np.empty(len(n))
        for first, last, lo, hi in zip(texts[:-1], texts[1:], cells[:-1], cells[1:], strict=True):
            doc, own, some = np.repeat(np.arange(last - first), n[first:last]), at[lo:hi].astype(np.int64), value[lo:hi]
            z = np.bincount(doc, some * theta[own], last - first) + theta[-1]
            off[first:last] = weight[first:last] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target[first:last])
            np.add.at(g, own, some * off[first:last][doc])
        g[-1] = off.sum()
        g += PENALTY * theta
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        theta -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.98 ** t)) + 1e-9)
    bias = float(theta[-1])
    return Scorer(theta[:WORD_BUCKETS], theta[WORD_BUCKETS:wide], bias, tuple(accuracies))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, lang: str = "lang") -> Scorer:
    """Votes of all documents, their accuracies, and a scorer fitted on an expected ``sample`` texts, drawn by key and text.

    ``lang``: column of the language, for its function words; without it few of them say nothing.
    Texts that are null teach nothing; an empty table gives a scorer that keeps everything.
    """
    known = docs.where(F.col(text).isNotNull())
    vote = _votes_of(docs, text, lang)
    counted = known.groupBy(vote.alias("votes")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(text)).alias("chars")).collect()
    counts = {tuple(r["votes"]): r["n"] for r in sorted(counted, key=lambda r: r["votes"])}
    post, accuracies = estimate(counts)
    rate = min(sample / max(sum(counts.values()), 1), SAMPLE_CHARS / max(sum(r["chars"] for r in counted), 1))
    draw = uniform(F.concat_ws(":", F.col(key).cast("string"), F.xxhash64(text).cast("string")), "quality")
    drawn = materialize(known.where(draw < rate).select(
        F.col(key).alias("key"), F.col(text).alias("text"), vote.alias("votes")), "quality-sample")
    rows = _bucketed(drawn.orderBy(F.col("key").asc_nulls_last(), "text")).collect()
    release(drawn)
    target = np.array([post[tuple(r["votes"])] for r in rows])
    n = np.array([len(r["at"]) // 2 for r in rows], np.int64)
    at, value = (np.frombuffer(b"".join([r[c] for r in rows]), kind) for c, kind in (("at", np.uint16), ("value", np.float64)))
    del rows
    return train(n, at, value, target, tuple(accuracies))


def score(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "score") -> DataFrame:
    """Add the scorer's likelihood of good text; all columns and rows stay (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.drop(out) if out != text else docs
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets()
        for batch in batches:
            texts, parts = batch.column(at), []
            for i in range(0, len(texts), 128):
                if len(memo) > MEMO:
                    memo.clear()
                parts.append(shared.value.score(texts[i:i + 128].to_pylist(), memo))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else [], pa.float64())],
                                             [*batch.schema.names, out])
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, DoubleType())]))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, kept)`` of every row; ``kept`` unless the score is below ``LEAST``.

    A null text is judged like an empty one, by what few words mean alone. Equal texts get equal scores; null keys are kept; an empty table gives
    an empty one.
    """
    scorer = fit(docs, key, text)
    out = score(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), scorer)
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= LEAST).alias("kept"))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that the classifier keeps, with their own columns."""
    scorer = fit(docs, key, text)
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, scorer, text, name).where(F.col(name) >= LEAST).drop(name)
