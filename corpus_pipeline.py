"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlake.llm import stages
from threadlake.llm.common import table, written

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("minhash_near_dedup", stages.near_dedup),
    ("benchmark_decontamination", stages.decontamination),
    ("pii", stages.personal_data),
    ("sentencepiece", stages.sentencepiece),
]

#: SQL can express neither the trained classifier nor the tokenizer's merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
