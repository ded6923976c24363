"""Language identification of code-switched text by a linear-chain conditional random field.

Every word of a text gets a language. A word's score is a sum over its affixes,
its character n-grams and, for frequent words, itself; learned transitions tie
neighbours together. Forward-backward gives each word's marginals, and a text's
language is the one with the largest sum of them.

The model is fitted on a bounded sample of labelled texts; the labelling runs in
Spark tasks over whole texts, many chains side by side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedtab.llm.common import uniform

#: Expected number of sampled texts of each language and of their characters, the bounds of the fit.
SAMPLE, SAMPLE_CHARS = 250, 2_000_000
#: Hashed features, times in the sample from which a word is a feature itself, words of a training segment.
BUCKETS, LEXICON, SEGMENT = 1 << 16, 3, 24
STEPS, RATE, PENALTY = 60, 0.15, 1e-6
#: A longer text's chain is worked off in pieces of this many words, side by side (speed only: its marginals stay the same).
CHAIN = 2000
#: Words a chain batch holds, and words whose scores a worker remembers (memory only).
BATCH_WORDS, MEMO = 300_000, 300_000
LETTERS = r"\p{L}+"
_MEMOS: dict = {}


@dataclass(frozen=True)
class LanguageModel:
    """Languages, feature weights ``(BUCKETS, languages)``, log transitions, log start and the words that are features."""

    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: frozenset[str]
    name: str = ""


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Hashed features of a lower-case word."""
    marked = f"^{word}$"
    found = [marked[i:i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    found += [f"p{word[:n]}" for n in (1, 2, 3, 4)] + [f"s{word[-n:]}" for n in (1, 2, 3, 4)]
    if word in lexicon:
        found.append(f"w{word}")
    return [crc32(x.encode()) % BUCKETS for x in found]


def _scores(words: list[str], lexicon: frozenset[str], weights: np.ndarray):
    """Emission scores of words and, for training, their features as (flat ids, starts, scale)."""
    ids = [features(w, lexicon) for w in words]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for v in ids for x in v), np.int64, int(sizes.sum()))
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    scale = 1 / np.sqrt(sizes)
    return np.add.reduceat(weights[flat], starts, axis=0) * scale[:, None], (flat, starts, sizes, scale)


def _ends(emit: np.ndarray, pieces: np.ndarray, counts: list[int], transitions: np.ndarray, start: np.ndarray):
    """What comes before and after each piece of the texts' chains: its vectors of entry and exit.

    ``pieces``: sizes of the pieces, ``counts``: pieces of each text. A piece is a matrix that takes the vector before it
    to that after it; the matrices of all pieces of long texts are made side by side, word by word, and one pass over
    a text's matrices in each direction gives the vectors. Vectors are scaled; only their directions count.
    """
    k, n = len(start), len(pieces)
    entry, exit_ = np.tile(np.exp(start), (n, 1)), np.ones((n, k))
    long = np.flatnonzero(np.repeat(np.array(counts) > 1, counts))
    if not len(long):
        return entry, exit_
    first = np.r_[0, np.cumsum(pieces)[:-1]]
    order = long[np.argsort(-pieces[long], kind="stable")]
    e = np.exp(emit - emit.max(1, keepdims=True))
    step = np.exp(transitions)
    through = np.empty((n, k, k))
    m = np.eye(k)[None] * e[first[order]][:, None, :]
    for t in range(1, pieces[order[0]]):
        alive = int(np.searchsorted(-pieces[order], -t, side="left"))  # pieces with a t-th word behind the first
        through[order[alive:len(m)]] = m[alive:]
        m = (m[:alive] @ step) * e[first[order[:alive]] + t][:, None, :]
        m /= m.max((1, 2), keepdims=True)
    through[order[:len(m)]] = m
    at = 0
    for c in counts:
        for i in range(at + 1, at + c):
            v = (entry[i - 1] @ through[i - 1]) @ step
            entry[i] = v / v.sum()
        for i in range(at + c - 2, at - 1, -1):
            v = step @ (through[i + 1] @ exit_[i + 1])
            exit_[i] = v / v.sum()
        at += c
    return entry, exit_


def _marginals(emit: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False,
               entry: np.ndarray | None = None, exit_: np.ndarray | None = None):
    """Marginals ``(words, languages)`` of chains laid end to end; with ``pairs`` also the expected transitions.

    ``entry`` and ``exit_``: what comes before and after each chain, if it is a piece of a longer one.
    """
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], (np.r_[0, np.cumsum(sizes)[:-1]])[order]
    e = np.exp(emit - emit.max(1, keepdims=True))
    step = np.exp(transitions)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # chains with a t-th word
    a = e[first] * (np.exp(start) if entry is None else entry[order])
    alpha[first] = a = a / a.sum(1, keepdims=True)
    for t in range(1, sizes[0]):
        at = first[:alive[t]] + t
        a = (a[:alive[t]] @ step) * e[at]
        alpha[at] = a = a / a.sum(1, keepdims=True)
    b = np.empty((0, e.shape[1]))
    total = np.zeros_like(transitions)
    for t in range(sizes[0] - 1, -1, -1):
        at = first[:alive[t]] + t
        n = len(b)
        ends = np.ones((alive[t] - n, e.shape[1])) if exit_ is None else exit_[order[n:alive[t]]]
        if n:
            ahead = b * e[at[:n] + 1]
            if pairs:
                joint = alpha[at[:n]][:, :, None] * step[None] * ahead[:, None, :]
                total += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = ahead @ step.T
            b = np.concatenate((b / b.sum(1, keepdims=True), ends))
        else:
            b = ends
        beta[at] = b
    gamma = alpha * beta
    return gamma / gamma.sum(1, keepdims=True), total


def _sequences(texts: list[tuple[str, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, word labels and chain sizes: segments of the texts, three in ten joined to one of another text."""
    import regex
    segments = []
    for text, label in texts:
        w = regex.findall(LETTERS, text.lower())
        segments += [(w[i:i + SEGMENT], label) for i in range(0, len(w), SEGMENT)]
    rng = np.random.default_rng(17)
    order = rng.permutation(len(segments))
    words, labels, sizes = [], [], []
    for k, i in enumerate(order):
        w, label = segments[i]
        if k and rng.random() < 0.3:
            sizes[-1] += len(w)
        else:
            sizes.append(len(w))
        words += w
        labels += [label] * len(w)
    return words, np.array(labels, np.int64), np.array(sizes, np.int64)


def train(texts: list[tuple[str, str]]) -> LanguageModel:
    """Fit by gradient steps (Adam) on the likelihood of the words' languages."""
    languages = tuple(sorted({x for _, x in texts}))
    words, labels, sizes = _sequences([(t, languages.index(x)) for t, x in texts])
    k = len(languages)
    if not words:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), frozenset())
    counted = Counter(words)
    lexicon = frozenset(w for w, c in counted.items() if c >= LEXICON)
    distinct = sorted(counted)
    number = {w: i for i, w in enumerate(distinct)}
    token = np.fromiter((number[w] for w in words), np.int64, len(words))
    weights, move, start = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
    _, (flat, starts, lengths, scale) = _scores(distinct, lexicon, weights)
    owner = np.repeat(np.arange(len(distinct)), lengths)
    gold = np.zeros((len(words), k))
    gold[np.arange(len(words)), labels] = 1
    head = np.r_[0, np.cumsum(sizes)[:-1]]
    inner = np.ones(len(words), bool)
    inner[head] = False
    pairs = np.zeros((k, k))
    np.add.at(pairs, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, move, start)]
    for t in range(1, STEPS + 1):
        emit = np.add.reduceat(weights[flat], starts, axis=0) * scale[:, None]
        gamma, expected = _marginals(emit[token], sizes, move, start, pairs=True)
        off = gold - gamma
        by_word = np.stack([np.bincount(token, off[:, j], len(distinct)) for j in range(k)], 1) * scale[:, None]
        by_feature = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS) for j in range(k)], 1)
        slopes = (by_feature / len(words) - PENALTY * weights, (pairs - expected) / len(words), off[head].sum(0) / len(head))
        for x, g, (m, v) in zip((weights, move, start), slopes, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x += RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.98 ** t)) + 1e-9)
    return LanguageModel(languages, weights.astype(np.float32), move, start, lexicon, str(crc32(weights.tobytes())))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on an expected ``sample`` texts of each language, and ``SAMPLE_CHARS`` of their characters, drawn by a hash of
    key and text.

    Rows without text, language or key teach nothing. The same table gives the same model.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    sizes = {r["lang"]: min(sample / r["n"], SAMPLE_CHARS / max(r["chars"], 1)) for r in known.groupBy(F.col(lang).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length(text)).alias("chars")).collect()}
    if not sizes:
        return train([])
    share = F.lit(0.0)
    for name, rate in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(rate)).otherwise(share)
    drawn = known.where(uniform(F.concat_ws(":", F.col(key).cast("string"), F.xxhash64(text).cast("string")), "language") < share).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).collect()
    return train([(r["text"], r["lang"]) for r in sorted(drawn, key=lambda r: (r["key"], r["lang"], r["text"]))])


class _Memo(dict):
    """Word -> row of its scores."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.rows = model, np.empty((0, len(model.languages)))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self)
        return len(self) - 1

    def scores(self) -> np.ndarray:
        if self.new:
            more, _ = _scores(self.new, self.model.lexicon, self.model.weights)
            self.rows, self.new = np.concatenate((self.rows, more)), []
        return self.rows


def _label(texts: list[str | None], memo: _Memo) -> Iterator[tuple[np.ndarray, list]]:
    """Per text the sum of its words' marginals and its runs of one language."""
    import regex
    words = regex.compile(LETTERS).findall
    model = memo.model
    at = 0
    while at < len(texts):
        tokens, counts, stop = [], [], at
        while stop < len(texts) and (stop == at or len(tokens) < BATCH_WORDS):
            w = words(texts[stop].lower()) if texts[stop] and model.languages else ()
            tokens.extend(map(memo.__getitem__, w))
            counts.append(len(w))
            stop += 1
        gamma = np.empty((0, len(model.languages)))
        if tokens:
            pieces = np.array([min(CHAIN, n - i) for n in counts for i in range(0, n, CHAIN)])
            emit = memo.scores()[np.array(tokens)]
            entry, exit_ = _ends(emit, pieces, [-(-n // CHAIN) for n in counts], model.transitions, model.start)
            gamma, _ = _marginals(emit, pieces, model.transitions, model.start, entry=entry, exit_=exit_)
        begin = 0
        for n in counts:
            g = gamma[begin:begin + n]
            begin += n
            best = g.argmax(1) if n else np.empty(0, int)
            cut = np.r_[0, np.flatnonzero(np.diff(best)) + 1, n] if n else np.zeros(1, int)
            yield g.sum(0), [(model.languages[best[a]], int(b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        at = stop
        if len(memo) > MEMO:
            memo.clear()
            memo.rows = memo.rows[:0]


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, n_letter_words, runs)`` of every row.

    ``score`` is the share of the predicted language in all words' marginals;
    ``runs`` lists the text's languages in order with their words. A text that is
    null or has no letter is ``und`` with score 0 and no runs, and so is every
    text if the model has seen no language. Equal texts get equal rows, null keys
    are kept, an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model.name not in _MEMOS:
            _MEMOS.clear()
            _MEMOS[model.name] = _Memo(model)
        for batch in batches:
            langs, scores, counts, runs = [], [], [], []
            for sums, parts in _label(batch.column(1).to_pylist(), _MEMOS[model.name]):
                best = int(sums.argmax()) if parts else -1
                langs.append(model.languages[best] if parts else "und")
                scores.append(min(1.0, float(sums[best] / sums.sum())) if parts else 0.0)
                counts.append(sum(n for _, n in parts))
                runs.append([{"lang": x, "words": n} for x, n in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(counts, pa.int64()), pa.array(runs, run_type)],
                ["key", "lang_pred", "score", "n_letter_words", "runs"])
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, n_letter_words long, "
                               "runs array<struct<lang:string,words:int>>")
    return out.withColumnRenamed("key", key)
