"""The corpus pipeline: drop toxic documents, keep one of each near-duplicate group, redact personal data, mix, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import mixing, ngram_join, private_data, toxicity
from tidemark.llm.common import crc_bucket, table
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import tokenizer_path
from tidemark.session import stage

#: The stages learn models and join by hashes, which SQL cannot say; the tests hold them against plain versions.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labelled documents among those given, but
    those held out for measuring it; without any, it rejects none."""
    weights = toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 3) != 1)
    return toxicity.score(docs, weights, 0.7).filter("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the least id."""
    return ngram_join.one_of_each(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    return private_data.redact(docs, private_data.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order. A document without words has no share in a mix."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_copies),
    ("private_data", redact_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before kept, written and read again between them."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
