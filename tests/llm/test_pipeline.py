"""The pipeline against plain Python over the same stages' inputs."""

import re

import public_tokenizers as public
import pytest
import tiktoken
from test_jaccard import brute

import corpus_pipeline
from fedtab.llm import mixing, pii, weak_quality
from fedtab.llm.bpe import read_ranks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("p") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns(stages):
    for s in stages[:-1]:
        assert s.columns == stages[0].columns
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids"]


def test_quality_stage(spark, stages):
    kept = {r.doc_id for r in weak_quality.judge(stages[0]).collect() if r.kept}
    assert rows(stages[1]) == sorted((tuple(r) for r in stages[0].collect() if r.doc_id in kept), key=str)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in kept for i, q in quality.items() if q == 1)


def test_near_copies_stage(stages):
    before = stages[1].collect()
    want = brute([(r.doc_id, r.text) for r in before], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert rows(stages[2]) == sorted((tuple(r) for r in before if want[r.doc_id][1] == r.doc_id), key=str)
    assert stages[2].count() < stages[1].count()


def test_personal_data_stage(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    spans = {r.doc_id: r.spans for r in pii.find_pii(stages[2], pii.fit(stages[2])).collect()}
    changed = 0
    for r in stages[3].collect():
        text, done = before[r.doc_id].text, []
        for x in filter(None, spans[r.doc_id].split(",")):
            kind, a, b = x.split(":")
            if done and done[-1][2] > int(a):
                done[-1][2] = max(done[-1][2], int(b))
            else:
                done.append([kind, int(a), int(b)])
        for kind, a, b in reversed(done):
            text = text[:a] + f"<{kind.upper()}>" + text[b:]
        changed += bool(done)
        assert r.text == text and r.n_chars == len(text)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text)
    assert changed


def test_mixing_stage(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(stages[3]).collect()}
    want = [tuple(r) for r in stages[3].collect() for _ in range(copies[r.doc_id])]
    assert rows(stages[4]) == sorted(want, key=str)


def test_tokens_stage_and_run(spark, stages):
    lib = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=read_ranks(public.path("byte_bpe_50k.tiktoken")),
                            special_tokens={})
    want = sorted(((r.doc_id, lib.encode_ordinary(r.text)) for r in stages[4].collect()), key=str)
    got = sorted(((r.doc_id, [int.from_bytes(r.ids[i:i + 4], "little") for i in range(0, len(r.ids), 4)])
                  for r in stages[5].collect()), key=str)
    assert got == want
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[5])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_table(spark, tmp_path):
    assert stages_of(spark, spark.createDataFrame([], SCHEMA), tmp_path)[-1] == []


def test_which_odd_rows_survive_each_stage(spark, tmp_path):
    """Nulls, empty texts, equal rows and texts without a key, among clean documents of one source."""
    clean = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars between 400 and 3000").select(
        "doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(30).collect()
    texts = [r.text + f" closing{i} words{i} of{i} number{i}" for i, r in enumerate(clean)]
    base = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    odd = [(None, None, None, None, None), (900, "", "en", "s", 0), (900, "", "en", "s", 0), (901, None, "en", "s", 7),
           (None, texts[0], "en", "s", 1), (None, "only " + texts[1][:300], "en", "s", 1), (None, "only " + texts[1][:300], "en", "s", 1),
           (902, texts[2], "en", "s", 5), (3, texts[3], "en", "s", len(texts[3]))]
    out = stages_of(spark, spark.createDataFrame(base + odd, SCHEMA), tmp_path)
    kept = [(r.doc_id, r.text) for r in out[0]]
    stay = {t for _, t in kept}
    assert sorted(kept, key=str) == sorted(((r[0], r[1]) for r in base + odd if r[1] in stay), key=str)  # equal texts alike
    copies = [(r.doc_id, r.text) for r in out[1]]
    one = lambda rows: {(k, t) for k, t in rows if t}
    assert len(one(copies)) == len([x for x in copies if x[1]])  # no row twice
    assert not any(x in copies for x in [(None, texts[0]), (902, texts[2])])
    assert all((i, t) in copies for i, t in enumerate(texts) if t in stay)
    if "only " + texts[1][:300] in stay:
        assert copies.count((None, "only " + texts[1][:300])) == 1
    for wordless in [(None, None), (900, ""), (901, None)]:
        assert (wordless in copies) == (wordless in kept)
    assert len(out[2]) == len(out[1]) and [r.text for r in out[2] if r.doc_id == 901] in ([], [None])
    assert all(r.n_chars == 7 for r in out[2] if r.doc_id == 901)
    assert {(r.doc_id, r.text) for r in out[3]} <= {(r.doc_id, r.text) for r in out[2]}
    assert len(out[4]) == len(out[3]) and all((r.n_tokens == 0) == (len(r.ids) == 0) for r in out[4])


def stages_of(spark, docs, folder):
    """The rows that every stage returns."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / f"{id(docs)}-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out
