import public_tokenizers as public
from tokenizers import Tokenizer

from fedtab.llm import token_counts as tc
from fedtab.session import shared_dir

PATH = public.path("byte_bpe_50k.json")


def test_counts_equal_the_library_and_only_misses_are_encoded(spark, monkeypatch):
    texts = [None, "", "a <|endoftext|> b", "hello world", "hello world", "é" * 5000, "new"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "null key", 1)],
                                 "doc_id long, text string, n_tokens long")
    lib = Tokenizer.from_file(PATH)
    cache = shared_dir(spark, "t-cache")
    first = {r.doc_id: r for r in tc.count_tokens(docs.where("doc_id is null or doc_id < 6"), PATH, cache).collect()}
    assert len(first) == 7
    sent = []
    real = tc.encode_counts
    monkeypatch.setattr(tc, "encode_counts", lambda t, p, v: sent.append(t.count()) or real(t, p, v))
    again = {r.doc_id: r for r in tc.count_tokens(docs, PATH, cache).collect()}
    assert sent == [1]  # only "new"
    for i, t in enumerate(texts):
        assert again[i].n_tokens == len(lib.encode(t or "", add_special_tokens=False).ids)
        assert again[i].n_bytes == len((t or "").encode())
    assert again[None].n_tokens == first[None].n_tokens > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(docs, PATH).collect() == []


def test_sentencepiece_model(spark):
    import sentencepiece
    path = public.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "hello there"), (2, "")], "doc_id long, text string")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, path).collect()}
    assert out == {1: len(lib.encode("hello there")), 2: 0}


def test_query_run_twice_with_one_cache(spark, monkeypatch):
    """The second run encodes nothing and returns the same; every count and limit is the library's."""
    from fedtab.llm.queries import llm_queries
    sf, cache = "/root/testdata/sf0.001", shared_dir(spark, "t-query-cache")
    lib = Tokenizer.from_file(PATH)
    run = llm_queries()["op10_token_counts"]
    first = sorted(map(tuple, run(spark, sf, cache=cache).collect()))
    sent = []
    real = tc.encode_counts
    monkeypatch.setattr(tc, "encode_counts", lambda t, p, v: sent.append(t.count()) or real(t, p, v))
    assert sorted(map(tuple, run(spark, sf, cache=cache).collect())) == first and sent == [0]
    want = []
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(lib.encode(d.text or "", add_special_tokens=False).ids)
        want.append((d.doc_id, len((d.text or "").encode()), n, n > 1024))
    assert first == sorted(want) and {r[3] for r in first} == {True, False}
