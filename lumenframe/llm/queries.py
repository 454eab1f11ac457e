"""The operators' registered queries: name -> (Spark query, SQL twin or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import audit_sql, bpe, crf, dart_minhash, debruijn, deobfuscation, divergence, mixing, nbsvm, outliers
from lumenframe.llm import removal_ranks, suffix_radix, token_files, winnowing


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that earlier documents hold."""
    found = suffix_radix.cleaned(_documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every text, its edited text and its next one."""
    return winnowing.edited_likeness(_documents(spark, sf_dir))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return dart_minhash.classes(_documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of every text, read back."""
    coded = token_files.write_and_read(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the languages that are not held out."""
    docs = _documents(spark, sf_dir)
    return crf.predict(docs, crf.train(docs))


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of text statistics."""
    judged = outliers.judge(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weights and sampling probabilities of every document."""
    found = mixing.weighted(_documents(spark, sf_dir))
    return found.select("doc_id", "source", "lang", F.col("_topic").cast("int").alias("topic"), F.col("_n_tokens").alias("n_tokens"), "weight", "prob", "sampled")


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labels that are not held out."""
    docs = _documents(spark, sf_dir)
    return nbsvm.score(docs, nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that earlier documents hold."""
    found = debruijn.cleaned(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every text by the multilingual ranks."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_removal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every source under every order."""
    return removal_ranks.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text, plain and disguised."""
    return deobfuscation.digests(deobfuscation.found(_documents(spark, sf_dir)))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its raised terms."""
    return divergence.audit(_documents(spark, sf_dir))


LLM_QUERIES = {
    "op1_suffix_radix": (op1_suffix_radix, None),
    "op2_winnowing": (op2_winnowing, None),
    "op3_dart_minhash": (op3_dart_minhash, None),
    "op4_token_files": (op4_token_files, None),
    "op5_crf_language": (op5_crf_language, None),
    "op6_robust_outliers": (op6_robust_outliers, None),
    "op7_mix_sources": (op7_mix_sources, None),
    "op8_nbsvm_quality": (op8_nbsvm_quality, None),
    "op9_debruijn_spans": (op9_debruijn_spans, None),
    "op10_bpe_words": (op10_bpe_words, None),
    "op11_removal_ranks": (op11_removal_ranks, audit_sql.REMOVAL_RANKS),
    "op12_deobfuscation": (op12_deobfuscation, None),
    "op13_divergence": (op13_divergence, audit_sql.DIVERGENCE),
}
