import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

from fedtab.llm.bpe import PerfectHash, Vocabulary, decode, encode, read_ranks

RANKS = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_perfect_hash_is_minimal_and_finds_only_its_keys():
    keys = [f"k{i}".encode() for i in range(5000)]
    ph = PerfectHash(keys)
    assert [ph.find(k) for k in keys] == list(range(5000))
    assert len(ph.keys) == 5000 and ph.find(b"none") == -1 and ph.find(b"") == -1
    assert PerfectHash([]).find(b"a") == -1


def test_merges_equal_the_library(reference):
    vocab = Vocabulary(read_ranks(RANKS))
    rng = random.Random(1)
    for _ in range(2000):
        piece = "".join(rng.choice("abctheingéß東🙂0 ") for _ in range(rng.randint(1, 30)))
        raw = piece.encode()
        assert vocab.merged(raw) == reference._core_bpe.encode_single_piece(raw), piece


def test_texts_with_nulls_specials_and_a_long_run(spark, reference):
    texts = [None, "", " ", "a\n\n b<|endoftext|>c", "x" * 20000, "größe 東京  \t café 🙂", "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, "y") for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids string")
    out = {(r.doc_id, r.n_tokens): (bytes(r.ids), bytes(r.raw))
           for r in decode(encode(docs, RANKS, public.PATTERN).withColumn("raw", F.col("ids")), RANKS, "raw", "raw")
           .join(encode(docs, RANKS, public.PATTERN).select(F.col("doc_id").alias("d"), F.col("ids").alias("i")),
                 F.col("d").eqNullSafe(F.col("doc_id"))).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        raw_ids, raw = out[(i or None, len(ids))]
        assert raw_ids == b"".join(x.to_bytes(4, "little") for x in ids)
        assert raw.decode() == (t or "")


def test_query_digests_every_document(spark, reference):
    from fedtab.llm.queries import llm_queries
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in llm_queries()["op3_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        assert out[d.doc_id].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert out[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(docs, RANKS, public.PATTERN), RANKS).collect() == []
