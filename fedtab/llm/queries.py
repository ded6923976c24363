"""One query per numbered operator, over the whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedtab.session import ship_package, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedtab.llm.quality_rules import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_license_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedtab.llm.license_align import scan_licenses
    found = scan_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(
        m["coverage"].alias("coverage"), (m["end"] - m["start"]).alias("chars"), m["license"].alias("license"))))
    return found.select("doc_id", best["license"].alias("license"),
                        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), F.size("matches").alias("n_matches"),
                        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])),
                                     ",").alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public
    from fedtab.llm.bpe import decode, encode
    ranks = public.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    ids = encode(docs, ranks, public.PATTERN).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(ids, ranks).select("doc_id", "n_tokens", "ids_sha256",
                                     F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedtab.llm.language_crf import fit, identify
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs.where(third != 1))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score",
                        "n_letter_words", F.size("runs").alias("n_runs"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedtab.llm.mixing import mix_sources
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedtab.llm.weak_quality import judge
    return judge(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedtab.llm.pii import find_pii, fit
    docs = table(spark, sf_dir, "documents")
    out = find_pii(docs, fit(docs))
    return out.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedtab.llm.rp_forest import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedtab.llm.jaccard import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """``cache``: the folder of stored counts that earlier runs have filled; a new one without it."""
    import public_tokenizers as public
    from fedtab.llm.token_counts import count_tokens
    counts = count_tokens(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; every second one by crc32 loses its line breaks and has to fail the check."""
    from fedtab.llm.merkle import folded_root, leaf_digest, merkle_manifest
    text = F.regexp_replace("text", "\n", "")
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaves = table(spark, sf_dir, "documents").select(
        "doc_id", "source", leaf_digest(["doc_id", "source", "lang", "n_chars", "text"]).alias("leaf"),
        F.when(changed, leaf_digest(["doc_id", "source", "lang", "n_chars", text])).alias("tampered"))
    out = merkle_manifest(leaves)
    folded = folded_root(F.coalesce("tampered", "leaf"), F.col("proof"), F.col("path"))
    return out.withColumn("folded_root", folded).select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, with one occurrence in 199 garbled."""
    from fedtab.llm.spelling import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"), garble_every=199)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; texts and labels of two thirds teach."""
    from fedtab.llm.toxicity import fit, predicted, score
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    classifier = fit(docs.where(~held_out), labels.where(~held_out))
    return score(docs, classifier).select("doc_id", held_out.alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Executors import the package before the query's own functions run there."""
    def run(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir, **more)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: _shipped(f) for f in found}
