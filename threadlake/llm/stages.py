"""The stages of the corpus pipeline. Each takes what its predecessor kept, all columns of it.

What holds for all of them: a null text counts as the empty text. Rows without an identifier go through the classifier, the decontamination and the
rewriting like any other and are nobody's duplicate; rows that repeat an identifier are one document for the deduplication, which keeps one of them. Very long texts are
read whole, one at a time. Columns beyond those of ``documents`` stay as they are, but for the last stage, which returns its own columns.
An empty table gives an empty one; without labels the classifier scores all texts alike, 0.5, and keeps them; without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, minhash, pii, quality, sentencepieces
from .common import table
from .queries import PIECE_BPE


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier takes for label 1; it learns from all labelled documents."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity 0.8 or more."""
    return minhash.deduplicated(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data, plain or disguised, replaced by its kind."""
    return pii.redact(docs, "text", "n_chars")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and the digests of ids and decoded text."""
    made = sentencepieces.encode_decode(docs, PIECE_BPE, ids=True)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
