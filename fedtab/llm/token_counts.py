"""Token counts with a digest cache.

A text's content digest and the tokenizer's version digest are joined to stored
counts. Only digests that have no count are encoded, each once, and their counts
are appended to the store.

The store is a Parquet folder of ``(version, digest, n_tokens)`` in the shared
folder, one sub-folder per version. The digest is sha256 of the text's bytes;
the only normalisation that cannot change a count is null -> empty.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.session import materialize, shared_dir

_TOKENIZERS: dict[str, object] = {}


def _load(path: str, version: str):
    """The tokenizer, loaded once per Python worker."""
    if version not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _TOKENIZERS[version] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer
            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _TOKENIZERS[version] = lambda texts: [
                len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _TOKENIZERS[version]


def tokenizer_version(path: str) -> str:
    """sha256 of the tokenizer file and of the library that reads it."""
    import sentencepiece
    import tokenizers
    lib = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + lib.encode()).hexdigest()


def encode_counts(texts: DataFrame, path: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` of ``(digest, text)`` rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _load(path, version)
        for batch in batches:
            rows = batch["text"].tolist()
            out: list[int] = []
            for at in range(0, len(rows), 64):  # few encodings alive at a time
                out += count(rows[at:at + 64])
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": out})
    return texts.select("digest", "text").mapInPandas(run, "digest string, n_tokens long")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored ``(digest, n_tokens)`` of one tokenizer version; empty if nothing is stored."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "digest string, n_tokens long")
    return spark.read.schema("digest string, n_tokens long").parquet(str(at))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_tokens)`` of every row of ``docs``; missing counts are added to ``cache``.

    ``path`` is a tokenizer file (.json or .model) that every executor can read;
    ``cache`` a folder in shared storage (a new one if not given). Null texts
    count as empty (0 tokens), equal texts are encoded once, rows with equal or
    null keys are all returned. A miss's text is fetched from the row with the
    least key of its digest, so the texts move on the key, which no hot text can
    make uneven. A digest that is appended twice (two runs at once) counts once.
    """
    spark = docs.sparkSession
    cache, version = cache or shared_dir(spark, "token-cache"), tokenizer_version(path)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    keys = materialize(rows.select("key", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = read_cache(spark, cache, version)
    misses = (keys.groupBy("digest").agg(F.min("key").alias("_key"))  # combined before the join: a hot text is one row a task
              .join(known, "digest", "left_anti"))
    texts = rows.alias("r").join(
        misses.alias("m"), (F.col("r.digest") == F.col("m.digest")) & F.col("r.key").eqNullSafe(F.col("m._key")))
    fresh = (encode_counts(texts.select("r.digest", "r.text"), path, version)
             .groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")))
    fresh.write.mode("append").parquet(f"{cache}/version={version}")
    counts = read_cache(spark, cache, version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    counts = materialize(counts, "counts")
    return keys.join(counts, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")
