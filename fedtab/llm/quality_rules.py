"""Quality rules: base counts, and divergence from language references.

A document's character-class histogram and its histogram of common words are
compared with those of each language, taken over the whole corpus, by
Jensen-Shannon distance. A document that is far from every language is rejected,
unless it is too short for its histogram to say anything.

Only DataFrame functions run here, and no document is taken apart into rows but
for the corpus word counts, which are combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fedtab.llm.common import WORD, words
from fedtab.session import materialize

#: Base rules.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Common words of each language that make its histogram, besides one bin for all other words.
COMMON = 40
#: Words that a document needs before a histogram can reject it.
GUARD_WORDS = 30
#: Largest distances (square root of the divergence in bits) from the nearest language: a limit for long texts
#: and a part that falls with the square root of the words, as the noise of a histogram does.
MOST_CLASS, MOST_WORD = (0.14, 1.2), (0.30, 0.9)
#: Character classes, in order; all other characters make the last bin.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{N}", "space": r"[\x20\x09-\x0D]",
           "symbol": r"[#*$%&|<>]", "point": r"[.,;:!?'()\x22-]"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """Words of ``w`` that lie in an n-word window found twice or more in it."""
    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
        reach = lambda p: F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n))))
        total = F.aggregate(let(let(ordered, positions), reach), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total)
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.when(F.size(w) > n, let(windows, covered)).otherwise(F.lit(0)).cast("long")


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


class Lookup:
    """A slot of its own for each of a few hashes: its bucket says by how much its place is moved.

    Buckets are placed by size, the fullest first, each by the first move that leaves all its hashes a free slot. With
    twice as many slots as hashes that takes a few tries a bucket, so the work follows their number; should a bucket
    find no move, other bits of the hashes give the places.
    """

    def __init__(self, hashes: list[int]) -> None:
        self.buckets = 1 << max(len(hashes) - 1, 1).bit_length()
        self.slots = 2 * self.buckets
        full: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            full.setdefault(h & (self.buckets - 1), []).append(i)
        order = sorted(full.items(), key=lambda x: (-len(x[1]), x[0]))
        if not any(self._placed(hashes, order, shift) for shift in range(24, 44)):
            raise ValueError("two words have one hash")

    def _placed(self, hashes: list[int], order: list[tuple[int, list[int]]], shift: int) -> bool:
        self.shift, self.moves, self.taken = shift, [0] * self.buckets, [-1] * self.slots
        for bucket, members in order:
            for move in range(self.slots):
                at = [(((hashes[i] & ((1 << 64) - 1)) >> shift) + move) & (self.slots - 1) for i in members]
                if len(set(at)) == len(at) and all(self.taken[a] < 0 for a in at):
                    break
            else:
                return False
            self.moves[bucket] = move
            for i, a in zip(members, at, strict=True):
                self.taken[a] = i
        return True

    def code(self, h: Column) -> Column:
        """Number of the hash in the slot of ``h``, or -1; it is another one's if ``h`` is not among them."""
        move = F.get(_numbers(self.moves, "int"), h.bitwiseAND(F.lit(self.buckets - 1)).cast("int"))
        at = (F.shiftrightunsigned(h, self.shift) + move).bitwiseAND(F.lit(self.slots - 1))
        return F.get(_numbers(self.taken, "int"), at.cast("int"))


def _lookup(docs: DataFrame, lang: str, text: str) -> tuple[list[str], list[str], dict, Lookup]:
    """Languages, common words, share of each common word by language, and the lookup of the common words.

    At most ``COMMON`` words of each language reach the driver.
    """
    counted = (docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
               .select(F.col(lang).alias("lang"), F.explode(words(F.lower(text))).alias("word"))
               .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    counted = materialize(counted, "word-counts")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = counted.withColumn("rank", first).where(F.col("rank") <= COMMON).select("word").distinct()
    shares: dict[str, dict[str, float]] = {x: {} for x in totals}
    hashes: dict[str, int] = {}
    for r in counted.join(common, "word").select("lang", "word", "n", F.xxhash64("word").alias("h")).collect():
        shares[r["lang"]][r["word"]] = r["n"] / totals[r["lang"]]
        hashes[r["word"]] = r["h"]
    vocabulary = sorted(hashes)
    return sorted(totals), vocabulary, shares, Lookup([hashes[w] for w in vocabulary])


def _numbers(values: list, kind: str) -> Column:
    """A constant array, folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _profile(docs: DataFrame, key: str, text: str, lang: str, vocabulary: list[str], lookup: Lookup) -> DataFrame:
    """One compact row per document: base counts, class counts and the counts of the common words in it."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), t.alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD))

    def counts(w: Column) -> Column:
        low = F.transform(w, lambda x: F.lower(x))
        if not vocabulary:
            return F.lit(None).cast("array<struct<code:int,n:int>>")
        names = F.array(*[F.lit(x) for x in vocabulary])
        found = let(low, lambda v: F.zip_with(
            v, F.transform(F.transform(v, lambda x: F.xxhash64(x)), lookup.code),
            lambda x, c: F.when((c >= 0) & (F.get(names, c) == x), c)))
        ordered = F.array_sort(F.filter(found, lambda c: c.isNotNull()))

        def runs(s: Column) -> Column:
            starts = F.filter(F.transform(s, lambda c, i: F.when((i == 0) | (F.get(s, i - 1) != c), i)),
                              lambda i: i.isNotNull())
            return let(starts, lambda b: F.transform(b, lambda x, i: F.struct(
                F.get(s, x).alias("code"), (F.coalesce(F.get(b, i + 1), F.size(s)) - x).alias("n"))))
        return let(ordered, runs)

    per_word = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"), counts(w).alias("common"))
    distinct = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return (rows.select(
        "key", "lang", let(words("text"), per_word).alias("w"), distinct.cast("long").alias("n_dup_lines"),
        F.char_length("text").cast("long").alias("chars"),
        F.array(*[_count(F.col("text"), p).cast("long") for c, p in CLASSES.items() if c != "space"]).alias("c"))
        .select("key", "lang", "w.*", "n_dup_lines", "chars", "c"))


def _classes() -> Column:
    """Class counts in order with the two bins that follow from the others."""
    at = [c for c in CLASSES if c != "space"]
    by = {c: F.get("c", F.lit(i)) for i, c in enumerate(at)} | {"space": F.col("chars") - F.col("word_chars")}
    known = [by[c] for c in CLASSES]
    total = known[0]
    for x in known[1:]:
        total = total + x
    return F.array(*known, F.col("chars") - total)


def _half(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def _divergence(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return (_half(p, m) + _half(q, m)) / 2


def _class_distance(reference: list[float]) -> Column:
    parts = [_divergence(F.get("classes", F.lit(i)) / F.col("chars"), F.lit(q)) for i, q in enumerate(reference)]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _word_distance(shares: list[float]) -> Column:
    """``shares``: of every common word in one language; 0 for words that are in its last bin."""
    q = _numbers(shares, "double")
    share = lambda x: F.get(q, x["code"])
    mine = F.filter("common", lambda x: share(x) > 0)
    other = 1.0 - sum(shares)
    n = F.col("n_words").cast("double")
    present = F.aggregate(mine, F.lit(0.0), lambda a, x: a + _divergence(x["n"] / n, share(x)) - share(x) / 2)
    rest = (n - F.aggregate(mine, F.lit(0.0), lambda a, x: a + x["n"])) / n
    return F.sqrt(F.greatest(present + F.lit(sum(shares) / 2) + _divergence(rest, F.lit(other)), F.lit(0.0)))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts and verdict of every row.

    ``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, word_distance, base_failed, kept)``. Distances are those of
    the nearest language; they are null below ``GUARD_WORDS`` words and where the
    corpus has no language, and then the base rules alone decide. A null or empty
    text has no words and fails. Documents without a language count in no
    reference but are judged like all others. Equal rows give equal rows; null
    keys are kept; an empty table gives an empty one.
    """
    languages, vocabulary, shares, lookup = _lookup(docs, lang, text)
    profile = materialize(_profile(docs, key, text, lang, vocabulary, lookup)
                          .withColumn("classes", _classes()), "profile")
    bins = range(len(CLASSES) + 1)
    sums = profile.where("lang is not null").groupBy("lang").agg(
        F.sum("chars").alias("chars"), *[F.sum(F.get("classes", F.lit(i))).alias(f"b{i}") for i in bins])
    classes = {r["lang"]: [r[f"b{i}"] / r["chars"] for i in bins] for r in sums.collect() if r["chars"]}
    guard = F.col("n_words") >= GUARD_WORDS
    nearest = lambda parts: F.least(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(None).cast("double")
    by_class = nearest([_class_distance(classes[x]) for x in languages if x in classes])
    by_word = nearest([_word_distance([shares[x].get(w, 0.0) for w in vocabulary])
                       for x in languages if shares[x]])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = profile.select(
        F.col("key").alias(key), "n_words", "word_chars",
        F.get("c", F.lit([c for c in CLASSES if c != "space"].index("symbol"))).alias("n_symbols"),
        "n_dup_lines", "n_repeat_words",
        F.when(guard, by_class).alias("class_distance"), F.when(guard, by_word).alias("word_distance"),
        failed.alias("base_failed"))
    within = lambda d, most: F.coalesce(F.col(d) <= most[0] + most[1] / F.sqrt("n_words"), F.lit(True))
    near = within("class_distance", MOST_CLASS) & within("word_distance", MOST_WORD)
    return out.withColumn("kept", ~F.col("base_failed") & near)
