import math
import re

import pytest
from pyspark.sql import functions as F

from fedtab.llm import quality_rules as q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string"


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def base(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


ODD = [None, "", " \n\t ", "one", "a b c d e", "a b c d e f", "a a a a a a a", "x y z w v\nx y z w v\n\nx y z w v",
       "a | b # 🙂 é c\n a | b # 🙂 é c", "q" * 30000, "w " * 4000, "a b c d e X a b c d e Y b c d e X"]


def test_base_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en") for i, t in enumerate(ODD)] + [(None, "a b", "en")],
                                 COLUMNS).withColumn("n_words", F.lit("clash")).withColumn("c", F.lit(1))
    out = {r.doc_id: r for r in q.quality_rules(docs).collect()}
    assert len(out) == len(ODD) + 1
    for i, t in enumerate(ODD):
        assert base(out[i]) == brute(t), t
        n, _, _, _, rep = brute(t)
        assert out[i].base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (out[i].kept and out[i].base_failed)


def jensen_shannon(p, r):
    half = lambda a, m: a * math.log2(a / m) if a else 0.0
    return math.sqrt(max(0.0, sum(half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, r, strict=True)) / 2))


def brute_distances(rows):
    """Nearest-language distances by plain counting."""
    kinds = [x for x in q.CLASSES]

    def classes(t):
        n = [len(re.findall(p, t)) for p in (r"[^\W\d_]", r"\d", r"[ \t-\r]", r"[#*$%&|<>]", r"[.,;:!?'()\"-]")]
        up = sum(c.isupper() for c in t)
        v = dict(zip(["letter", "digit", "space", "symbol", "point"], n, strict=True))
        v["upper"], v["lower"] = up, sum(c.islower() for c in t)
        out = [v[k] for k in kinds]
        return out + [len(t) - sum(out)]
    langs = sorted({x for _, _, x in rows if x})
    share, ref = {}, {}
    for x in langs:
        w = [v for _, t, lang in rows if lang == x for v in WORDS.findall(t.lower())]
        share[x] = {v: w.count(v) / len(w) for v in set(w)}
        total = [sum(c) for c in zip(*[classes(t) for _, t, lang in rows if lang == x], strict=True)]
        ref[x] = [c / sum(total) for c in total]
    common = sorted({v for x in langs for v in sorted(share[x], key=lambda v: (-share[x][v], v))[:q.COMMON]})
    out = {}
    for i, t, _ in rows:
        w = WORDS.findall(t.lower())
        if len(w) < q.GUARD_WORDS:
            continue
        c = classes(t)
        by_word = []
        for x in langs:
            mine = [v for v in common if share[x].get(v)]
            r = [share[x][v] for v in mine]
            p = [w.count(v) / len(w) for v in mine]
            by_word.append(jensen_shannon([*p, 1 - sum(p)], [*r, 1 - sum(r)]))
        out[i] = (min(jensen_shannon([v / sum(c) for v in c], ref[x]) for x in langs), min(by_word))
    return out


def test_distances_equal_plain_counting(spark):
    rows = [(r.doc_id, r.text, r.lang if r.doc_id % 7 else None) for r in
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = brute_distances(rows)
    out = {r.doc_id: r for r in q.quality_rules(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert len(want) > 100
    for i, r in out.items():
        got = (r.class_distance, r.word_distance)
        assert got == (pytest.approx(want[i], abs=1e-9) if i in want else (None, None)), i


def test_verdicts_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))
    both = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, junk = ([r.kept for r in both if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.995 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_no_language_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", None)] * 2, COLUMNS)
    assert [(r.kept, r.word_distance) for r in q.quality_rules(docs).collect()] == [(True, None)] * 2
    assert q.quality_rules(docs.limit(0)).collect() == []


def test_only_native_operators(spark):
    plan = q.quality_rules(spark.createDataFrame([(1, "a b", "en")], COLUMNS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lookup_of_very_many_common_words(spark):
    """Two hundred languages of forty words: each word finds itself, nothing else finds one."""
    words = [f"{a}{i}" for a in "abcdefghij" for i in range(800)]
    df = spark.createDataFrame([(w,) for w in words] + [(f"no{i}",) for i in range(500)], "w string")
    rows = df.select("w", F.xxhash64("w").alias("h")).collect()
    lookup = q.Lookup([r.h for r in rows[:len(words)]])
    assert lookup.slots <= 4 * len(words)
    out = df.select("w", lookup.code(F.xxhash64("w")).alias("c")).collect()
    assert all(words[r.c] == r.w for r in out[:len(words)])
    assert all(r.c == -1 or words[r.c] != r.w for r in out[len(words):])
    with pytest.raises(ValueError, match="one hash"):
        q.Lookup([5, 5])


def test_very_many_languages(spark):
    """Every language has its own reference, however many there are."""
    rows = [(k, " ".join(f"w{k}x{i % 12}" for i in range(40)), f"l{k}") for k in range(200)]
    out = q.quality_rules(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(out) == 200 and all(r.word_distance < 0.01 for r in out)


def test_query_on_the_documents(spark):
    from fedtab.llm.queries import llm_queries
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in llm_queries()["op1_quality_rules"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        r, want = out[d.doc_id], brute(d.text)
        assert base(r) == want and r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(out[k].kept or out[k].base_failed for k, q in quality.items() if q == 1)
