import hashlib
import random
import re

from pyspark.sql import functions as F

from fedtab.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else False,
            "card": 14 <= len(digits) <= 19 and checksum(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, k in enumerate(PLAIN)
             for m in re.finditer(PLAIN[k], text or "") if good(k, m.group(0))]
    return sorted(found)


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


ODD = [None, "", "none", "a@b.com", "🙂 é x@y.org_z@w.net+q@r.s.t. u@v", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 0255.0.0.1 1..2.3.4",
       "4111 1111 1111 1111, 4111-1111-1111-1112 and 4 1 1 1", "+1 (555) 010-9999 x +49.30.1234567 +1 ) +12", "+12345678901234567",
       "a" * 200000, "1" * 50000, "1 " * 30000, "+1" + " " * 50000, "@" * 100, "..@..com a.@b.c", "x" * 3000 + "@y.zz",
       "password=531ccd051a92ebcb68 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "1.2.3.4 a@b.c 1.2.3.4@d.e"]


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    return {r.doc_id: r for r in pii.find_pii(docs, pii.fit(docs)).collect()}


def check(out, texts):
    for i, t in enumerate(texts):
        want = brute(t)
        assert out[i].base == joined(want), t[:80]
        assert [out[i][f"n_{k}"] for k in PLAIN] == [sum(x[3] == k for x in want) for k in PLAIN]
        assert set(filter(None, out[i].base.split(","))) <= set(filter(None, out[i].spans.split(",")))


def test_base_spans_of_odd_texts(spark):
    check(run(spark, ODD), ODD)


def test_base_spans_of_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0011..@+- ()ab_é\n4") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    check(run(spark, texts), texts)


def test_query_on_the_documents(spark):
    from fedtab.llm.queries import llm_queries
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in llm_queries()["op7_pii"](spark, sf).collect()}
    planted = secrets = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = joined(brute(d.text))
        planted += bool(want)
        assert out[d.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        for m in re.finditer(r"(?:password=|token = \")([0-9a-f]{16,})", d.text or ""):
            secrets += 1
            assert f"secret:{m.start(1)}:{m.end(1)}" in out[d.doc_id].spans.split(",")
    assert planted > 10 and secrets > 3


def test_expectation_maximisation_finds_the_bad_labeler():
    rng = random.Random(4)
    counts = {}
    for _ in range(20000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth == (rng.random() < a) else -1) for a in (0.95, 0.9, 0.85, 0.5, 0.8))
        counts[0, votes, False] = counts.get((0, votes, False), 0) + 1
    post, agrees = pii.estimate(counts)
    assert all(abs(x - a) < 0.05 for x, a in zip(agrees, (0.95, 0.9, 0.85, 0.5, 0.8), strict=True))
    w = pii.train(counts, post)
    assert w[5] > w[11] and w[6] < 0  # the first labeler's vote counts for more than the fourth's


def test_redaction(spark):
    texts = [None, "", "mail a@b.com, ip 1.2.3.4!", "4111 1111 1111 1111", "é 🙂 +1 (555) 010-9999.", "1.2.3.4@d.e x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("s", F.lit(1))
    out = pii.redact(docs, pii.fit(docs))
    assert out.columns == docs.columns
    got = [r.text for r in out.orderBy("doc_id").collect()]
    assert got == [None, "", "mail <EMAIL>, ip <IP>!", "<CARD>", "é 🙂 <PHONE>.", "<EMAIL> x"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(docs, pii.fit(docs)).collect() == [] and pii.redact(docs, pii.fit(docs)).collect() == []


def test_running_sums_and_maxima(spark):
    rng = random.Random(6)
    rows = [([rng.randint(0, 50) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 16, 17, 300)]
    df = spark.createDataFrame(rows, "v array<int>")
    for r in df.select("v", pii.running(F.col("v"), lambda a, x: a + x, 0).alias("s"),
                       pii.running(F.col("v"), lambda a, x: F.greatest(a, x), 0).alias("m")).collect():
        assert r.s == [sum(r.v[:i + 1]) for i in range(len(r.v))]
        assert r.m == [max(r.v[:i + 1]) for i in range(len(r.v))]


def test_texts_of_very_many_numbers(spark):
    """Short numbers are passed over; the work of many spans in one text stays near their number."""
    short = ", ".join(str(10 + i % 90) for i in range(400_000))
    spans = " and ".join("1.2.3.%d" % (i % 250) for i in range(20_000)) + "\n" + "; ".join(["4111111111111111"] * 5_000)
    check(run(spark, [short, spans]), [short, spans])
    docs = spark.createDataFrame([(1, spans)], "doc_id long, text string")
    text = pii.redact(docs, pii.fit(docs)).first().text
    assert text == " and ".join(["<IP>"] * 20_000) + "\n" + "; ".join(["<CARD>"] * 5_000)


def test_overlapping_spans_are_replaced_together(spark):
    """A long span holds several others: the first one's kind stands for all of them."""
    texts = ["a1b2c3d4e5f6g7h8i9@1.2.3.4 and 5.6.7.8", "+1.2.3.4.5.6.7.8.9.0 1.1.1.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.SpanModel((1.0,) * (len(pii.KINDS) + 2 * len(pii.LABELERS)), (1.0,) * len(pii.LABELERS))
    for r, t in zip(pii.redact(docs, model).orderBy("doc_id").collect(), texts, strict=True):
        spans = sorted((s["start"], s["kind"], s["end"]) for s in docs.where(docs.doc_id == r.doc_id).select(
            pii.candidates("text").alias("s")).first().s)
        groups = []
        for start, kind, end in spans:
            if groups and groups[-1][2] > start:
                groups[-1] = (*groups[-1][:2], max(groups[-1][2], end))
            else:
                groups.append((start, kind, end))
        want, at = "", 0
        for start, kind, end in groups:
            want += t[at:start] + f"<{pii.KINDS[kind].upper()}>"
            at = end
        assert r.text == want + t[at:] and len(spans) > len(groups)
