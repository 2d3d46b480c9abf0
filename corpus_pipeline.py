"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlens.llm import stages
from threadlens.llm.common import scratch

STAGES = [
    ("toxicity", stages.toxicity),
    ("simhash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.decontaminate),
    ("personal data", stages.redact),
    ("bpe", stages.tokenize),
]

# Learned scores, 64-bit SimHash links and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
