"""Spelling variants of words, by pivotal grams.

Words of a corpus that differ by exactly one inserted, deleted or replaced code
point are near. Each word's bigrams are ordered by how rare they are in the
vocabulary. Its prefix are its three rarest ones (and what ties with the third);
its pivots are two of them that share no character, the rarest such pair, chosen
by dynamic programming. One edit cannot touch both pivots, so of two near words
the one whose prefix ends earlier in the order has a pivot that the other has in
its prefix; and on one side of that bigram the two words are the same.

So pivots are joined with prefixes on the bigram and the text before it (its
position is the same) or after it (its distance from the end is the same), and
the edit distance of each pair that fits in length is computed. All pairs are
found; a word's lists grow with the words that share its rare bigram and that
side, and AQE splits a list that is too long for one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedtab.session import materialize, release

#: Letters of a word: at most 90 after lower-casing, so there are at most 8,100 bigrams.
LETTER = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT = 6, 5
#: A word's form occurs at least so many times as often.
FACTOR = 5
GRAM, EDITS = 2, 1
#: Grams of which one survives any ``EDITS`` edits with ``EDITS + 1`` disjoint ones among them.
PREFIX = GRAM * EDITS + 1


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, everything else as it is (most words have no capital and skip the slow part)."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def garbled(word: Column, key: Column, every: int) -> Column:
    """The word with one code point deleted where ``every`` divides the crc32 of ``<key>:<word>``; a null key deletes none."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                least_count: int = LEAST_COUNT, garble_every: int | None = None) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters in all whole texts, of at least these lengths and counts.

    ``garble_every`` deletes a code point of some occurrences first (see ``garbled``), to plant variants.
    A null text has no words; equal rows count each; an empty table gives an empty one.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{LETTER}{{{least_chars},}}"), F.lit(0))
    word = docs.select(F.col(key).alias("key"), F.explode(runs).alias("run")).select("key", lower_ascii(F.col("run")).alias("word"))
    if garble_every:
        word = word.select(garbled(F.col("word"), F.col("key"), garble_every).alias("word"))
    return (word.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def choose_pivots(grams: list[tuple[int, int]], wanted: int = EDITS + 1) -> list[int]:
    """Positions of ``wanted`` disjoint grams of the least total weight, by dynamic programming.

    ``grams``: (position, weight). ``best[k][i]``: the least weight of k disjoint grams, the last of them gram i.
    """
    grams = sorted(grams)
    best = [{i: (w, (p,)) for i, (p, w) in enumerate(grams)}]
    for _ in range(1, wanted):
        last, now = best[-1], {}
        for i, (p, w) in enumerate(grams):
            before = [last[j] for j in last if grams[j][0] + GRAM <= p]
            if before:
                weight, chosen = min(before)
                now[i] = (weight + w, (*chosen, p))
        best.append(now)
    return list(min(best[-1].values())[1])


def signature(word: str, rank: dict[str, int], weight: dict[str, int]) -> tuple[list[int], list[int], int]:
    """Pivot positions, prefix positions and the rank at which the prefix ends."""
    ranks = [rank[word[i:i + GRAM]] for i in range(len(word) - GRAM + 1)]
    order = sorted(range(len(ranks)), key=lambda i: (ranks[i], i))
    last = ranks[order[min(PREFIX, len(order)) - 1]]
    pivots = choose_pivots([(i, weight[word[i:i + GRAM]]) for i in order[:PREFIX]])
    return pivots, [i for i in range(len(ranks)) if ranks[i] <= last], last


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``: all pairs of near words, each in both directions.

    ``vocabulary``: ``(word, n)``, distinct words of at least six code points, so that two disjoint grams
    are always among the three rarest. Every pair is compared by ``levenshtein``.
    """
    grams = vocabulary.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1)), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("gram"))
    weight = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {g: i for i, g in enumerate(sorted(weight, key=lambda g: (weight[g], g)))}

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"], strict=True):
                pivots, prefix, last = signature(word, rank, weight)
                for i in prefix:
                    for side, affix, cut in (("before", word[:i + GRAM], (len(word) + i + GRAM) // 2), ("after", word[i:], i // 2)):
                        halves = (word[:cut], word[cut:]) if i in pivots else (None, None)
                        rows.append((side, affix, last, len(word), word, n, *halves))
            yield pd.DataFrame(rows, columns=["side", "affix", "last", "size", "word", "n", "head", "tail"])
    signed = vocabulary.select("word", "n").mapInPandas(
        sign, "side string, affix string, last int, size int, word string, n long, head string, tail string")
    signed = materialize(signed, "signatures")
    a, b = signed.where("head is not null").alias("a"), signed.drop("head", "tail").alias("b")
    # The edit is on the other side of the bigram; of the two halves of what is there it leaves one as it is.
    fits = ((F.col("a.side") == F.col("b.side")) & (F.col("a.affix") == F.col("b.affix")) & (F.col("a.last") <= F.col("b.last"))
            & (F.abs(F.col("a.size") - F.col("b.size")) <= EDITS) & (F.col("a.word") != F.col("b.word"))
            & (F.startswith(F.col("b.word"), F.col("a.head")) | F.endswith(F.col("b.word"), F.col("a.tail")))
            & (F.levenshtein("a.word", "b.word", EDITS) == EDITS))
    found = a.join(b, fits).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"),
                                   F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))
    return found.union(found.select("other", "other_n", "word", "n")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form, by pointer jumping: each round doubles the way followed.

    A form occurs ``FACTOR`` times as often, so ways are short (27 steps at most for any count) and have no circles.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        before = state
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = materialize(state.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(before)
        if state.where("moved").isEmpty():
            return state.select("word", "root")


def variant_groups(vocabulary: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of a vocabulary ``(word, n)`` (see ``near_words``).

    ``form``: the near word of largest n (ties: the smallest in code-point order), if that is at least ``FACTOR``
    times the word's own; else null. ``root``: the last word on the way along the forms, the word itself if it has
    none. An empty vocabulary gives an empty table.
    """
    near = near_words(vocabulary)
    best = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"),
                                         F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    often = -F.col("best.n") >= FACTOR * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(often, F.col("best.word")).alias("form"),
                                   F.when(often, -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(best.where("form is not null"))
    return (vocabulary.select("word", "n").join(best, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", garble_every: int | None = None) -> DataFrame:
    """``variant_groups`` of the words of all texts."""
    return variant_groups(materialize(count_words(docs, key, text, garble_every=garble_every), "vocabulary"))
