import random
import re
from collections import Counter
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from fedtab.llm.queries import llm_queries
from fedtab.llm.spelling import choose_pivots, count_words, near_words, signature, spelling_variants, variant_groups

COLUMNS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one edit, by trying them all."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups(n):
    """Rows of ``variant_groups`` by comparing every word with every other."""
    out, form = [], {}
    for w in n:
        others = sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o.encode()))
        form[w] = (others[0] if others and n[others[0]] >= 5 * n[w] else None), len(others)
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n[w], form[w][1], n[form[w][0]] if form[w][0] else None))
    return sorted(out)


def counts(rows, every=None):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{key}:{run}".encode())
            if every and key is not None and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def vocabulary(seed, size, letters="abcdé"):
    rng = random.Random(seed)
    n = {}
    while len(n) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) if rng.random() < 0.4 or not n else rng.choice(list(n))
        for _ in range(rng.randint(0, 2)):
            i, kind = rng.randrange(len(w)), rng.random()
            w = w[:i] + (rng.choice(letters) if kind < 0.7 else "") + w[i + (kind < 0.4 or kind >= 0.7):]
        if len(w) >= 6:
            n[w] = rng.choice([5, 6, 25, 30, 150, 900])
    return n


def test_equals_comparing_all_pairs(spark):
    for seed, letters in ((1, "abcdé"), (2, "ab"), (3, "abcdefghijklmnopqrstuvwxyzß")):
        n = vocabulary(seed, 250, letters)
        out = variant_groups(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3))
        assert sorted(map(tuple, out.collect())) == groups(n)


def test_words_of_one_letter_and_shared_bigrams(spark):
    n = {"a" * k: 5 ** (12 - k) for k in range(6, 12)} | {"abab" * 2: 7, "baba" * 2: 7, "ababab": 50, "abababa": 9}
    out = variant_groups(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted(map(tuple, out.collect())) == groups(n)


def test_a_hot_affix_loses_no_pair(spark):
    """Every word starts with the same rare bigram, a third of them differ in one place only."""
    n = {"xq" + "".join(chr(97 + (i // 26 ** k) % 26) for k in range(4)): 5 + i % 40 for i in range(400)}
    out = near_words(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted((r.word, r.other) for r in out.collect()) == sorted((a, b) for a in n for b in n if near(a, b))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = list(vocabulary(6, 60, "abcdefgh"))
    rows = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words[:1 + int(60 * rng.random() ** 3)])
                         for _ in range(120))) for i in range(60)]
    rows += [(None, "strange strange Ünder"), (90, None), (91, ""), (7, rows[7][1])]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    out = llm_queries()["op12_spelling_variants"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == groups(counts(rows, 199)) and any(r.form for r in out)


def test_words_are_whole_runs_lower_cased_in_ascii_only(spark):
    rows = [(i, "ÀBCDEF àbcdef short abcdef1ghijkl don't_xabcde × " + "Long" * 5000) for i in range(5)] + [(None, None), (1, "")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], COLUMNS + ", n int, word string")
    got = {r.word: r.n for r in count_words(docs).collect()}
    assert got == counts(rows) and {"Àbcdef", "àbcdef", "abcdef", "ghijkl", "xabcde", "long" * 5000} == set(got)
    garbled = {r.word: r.n for r in count_words(docs, garble_every=2).collect()}
    assert garbled == counts(rows, 2)


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], COLUMNS)).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, "a few shorter")], COLUMNS)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=6, max_size=9), st.integers(0, 8), st.sampled_from(["insert", "delete", "replace"]), st.sampled_from("abc"))
def test_a_pivot_of_one_word_survives_in_the_other(word, at, kind, letter):
    """The lemma of the filter: side and bigram of a pivot agree with the other's prefix."""
    at %= len(word)
    other = word[:at] + (letter if kind != "delete" else "") + word[at + (kind != "insert"):]
    if len(other) < 6 or other == word:
        return
    weight = Counter(w[i:i + 2] for w in (word, other) for i in range(len(w) - 1))
    rank = {g: i for i, g in enumerate(sorted(weight, key=lambda g: (weight[g], g)))}
    signed = {w: signature(w, rank, weight) for w in (word, other)}
    first, second = sorted((word, other), key=lambda w: signed[w][2])
    met = lambda w, places: {(s, x) for i in places for s, x in (("l", w[:i + 2]), ("r", w[i:]))}
    assert met(first, signed[first][0]) & met(second, signed[second][1])


@given(st.lists(st.integers(1, 20), min_size=3, max_size=6))
def test_pivots_are_the_lightest_disjoint_pair(weights):
    grams = list(enumerate(weights))
    chosen = choose_pivots(grams)
    best = min(a + b for i, a in grams for j, b in grams if j >= i + 2)
    assert chosen[1] >= chosen[0] + 2 and sum(weights[i] for i in chosen) == best
