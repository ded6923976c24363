import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedtab.llm import language_crf as crf

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    k, sizes = 3, np.array([4, 1, 5, 2])
    emit, move, start = rng.standard_normal((12, k)), rng.standard_normal((k, k)), rng.standard_normal(k)
    gamma, pairs = crf._marginals(emit, sizes, move, start, pairs=True)
    want, joint, at = np.zeros((12, k)), np.zeros((k, k)), 0
    for n in sizes:
        paths = list(itertools.product(range(k), repeat=int(n)))
        score = np.array([np.exp(start[p[0]] + sum(emit[at + i, y] for i, y in enumerate(p))
                                 + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
        for p, w in zip(paths, score / score.sum(), strict=True):
            for i, y in enumerate(p):
                want[at + i, y] += w
            for a, b in zip(p, p[1:], strict=False):
                joint[a, b] += w
        at += n
    assert np.allclose(gamma, want) and np.allclose(pairs, joint)


@pytest.mark.parametrize("piece", [1, 2, 7, 50])
def test_pieces_of_a_chain_give_the_marginals_of_the_whole(piece):
    rng = np.random.default_rng(2)
    k, sizes = 4, np.array([50, 1, 7, 23, 14, 100])
    emit, move, start = 3 * rng.standard_normal((sizes.sum(), k)), rng.standard_normal((k, k)), rng.standard_normal(k)
    want, _ = crf._marginals(emit, sizes, move, start)
    pieces = np.array([min(piece, n - i) for n in sizes for i in range(0, n, piece)])
    entry, exit_ = crf._ends(emit, pieces, [-(-n // piece) for n in sizes], move, start)
    got, _ = crf._marginals(emit, pieces, move, start, entry=entry, exit_=exit_)
    assert np.allclose(got, want, atol=1e-12)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return crf.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def test_held_out_accuracy_and_query(spark, model):
    from fedtab.llm.queries import llm_queries
    out = llm_queries()["op4_language_crf"](spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and 200 < len(held) < 500 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_switched_text_is_cut_where_it_switches(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 3000").collect()}
    import regex
    words = {k: regex.findall(crf.LETTERS, v)[:60] for k, v in docs.items()}
    text = " ".join(words["de"] + words["es"])
    row = crf.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [x["lang"] for x in row.runs] == ["de", "es"] and abs(row.runs[0]["words"] - 60) <= 2


def test_labels_do_not_depend_on_the_length_of_pieces(spark, model, monkeypatch):
    """A text that switches back and forth for tens of thousands of words."""
    text = " ".join(["the house of the king " * 40, "das haus von dem und der " * 30] * 60)
    whole = []
    for piece in (10 ** 9, 2000, 333):
        monkeypatch.setattr(crf, "CHAIN", piece)
        whole.append([(g.round(9).tolist(), runs) for g, runs in crf._label([text, "the of", text], crf._Memo(model))])
    assert whole[0] == whole[1] == whole[2] and len(whole[0][0][1]) > 50


def test_odd_texts(spark, model):
    texts = [None, "", "123 | ²", "the", "a" * 50000, "the of and " * 30000, "der die und " * 100, "der die und " * 100]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "the", "x")],
                                 "doc_id long, text string, score string")
    out = {r.doc_id: r for r in crf.identify(docs, model).collect()}
    assert [out[i].lang_pred for i in range(3)] == ["und"] * 3 and all(out[i].score == 0 for i in range(3))
    assert out[5].n_letter_words == 90000 and sum(x["words"] for x in out[5].runs) == 90000
    assert out[5].lang_pred == "en" and out[6].lang_pred == "de" and out[6][1:] == out[7][1:] and None in out


def test_no_labels_and_empty_table(spark, model):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    none = crf.fit(docs)
    assert [(r.lang_pred, r.score) for r in crf.identify(docs, none).collect()] == [("und", 0.0)]
    assert crf.identify(docs.limit(0), model).collect() == []


def test_the_same_table_gives_the_same_model(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    again = crf.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    assert np.array_equal(again.weights, model.weights) and again.languages == model.languages
