"""The registered query of each operator, on whole tables with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytespans, classifier, licenses, minhash, mixing, packing, pii, rules, topk, wordspans
from .scratch import read

#: setting of the session with the secret key of pseudonyms
PII_KEY = "spark.loomfield.pii.key"


def pii_key(spark: SparkSession) -> str:
    """The session's key. Without one a random key is made and kept in the session, so what runs in one session is linked."""
    key = spark.conf.get(PII_KEY, None) or spark.sparkContext.getConf().get(PII_KEY)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(PII_KEY, key)
    return key


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytespans.remove_strings(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(read(spark, sf_dir, "documents")))
    failed = F.col("fail_bits").bitwiseAND(F.lit(rules.BASE).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read(spark, sf_dir, "documents"), pii_key(spark))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordspans.remove_spans(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffixes": op1_suffixes,
    "op2_minhash": op2_minhash,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_topk": op7_topk,
    "op8_pii": op8_pii,
    "op9_substrings": op9_substrings,
    "op10_classifier": op10_classifier,
}
