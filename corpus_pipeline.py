"""A training corpus from ``documents`` in five stages.

Each stage takes all that the one before kept; tables between stages are Parquet in the folder the
session shares with its executors. All stages but the last return the columns of ``documents``.

Definitions: a null or empty text is judged by its site, is linked with nothing, has nothing to
replace, and is not mixed, as it has no words; very long texts are taken whole; of rows that repeat
doc_id and text one stays; rows without doc_id are linked with nothing and stay; the null source and the
empty one are two sources; ties are broken by hashes of ids, so reruns in a session agree; other
columns pass through whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import classifier, minhash, mixing, packing, pii
from loomfield.llm.queries import pii_key, tokenizer
from loomfield.llm.scratch import Scratch, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (low quality or toxic) go."""
    return classifier.judged(docs, read(spark, sf_dir, "labels"), keep=docs.columns).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return minhash.without_near_duplicates(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is permuted within its format; nothing goes."""
    return pii.pseudonymize(docs, pii_key(spark), keep=docs.columns, spans=False)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents go, stay, or repeat."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_documents(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("PII", pseudonyms),
    ("mixing", mixed),
    ("packing", packed),
]

#: subword tokens and fitted models are beyond SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir).select(F.col("*"))
