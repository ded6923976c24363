"""The corpus pipeline: stages over ``documents``, each writing what the next one reads.

Junk goes, one document of each group of near copies stays, personal data is
replaced, sources are brought to their target weights and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.llm import bpe, jaccard, mixing, pii, weak_quality
from fedtab.session import materialize, release, ship_package, table

#: Near copies: word 5-grams, at least 80 of 100 in common.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality classifier does not reject.

    A null text is judged like an empty one; equal texts stay or go together; an empty table stays empty.
    """
    ship_package(spark)
    return weak_quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join: the one with the least ``doc_id``.

    Of rows of equal ``doc_id`` and text one stays. Documents whose ``doc_id`` is null take part, and one with a
    ``doc_id`` stays before them. Texts that are null or have no word are in no group and stay.
    """
    ship_package(spark)
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; ``n_chars`` follows the new text.

    All rows stay. Null texts stay null and keep their ``n_chars``; equal texts change alike.
    """
    ship_package(spark)
    out = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        changed = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until every source has about its target of words.

    A null source is a source. Documents without words count nothing and are repeated at their source's rate (none
    where the source has no word at all). Rows of equal ``doc_id``, source and text are drawn alike.
    """
    ship_package(spark)
    return mixing.emit_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit).

    All rows stay, also with a null or repeated ``doc_id``; a null text has no ids.
    """
    ship_package(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("mixing sources", mix),
    ("byte-level BPE", tokens),
]

#: Two stages fit models by expectation-maximisation, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet to the shared folder and read again.

    A stage's table goes when the next one is written.
    """
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        release(docs)
        docs = done
    return docs
