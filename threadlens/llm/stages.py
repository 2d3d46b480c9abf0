"""Stages of the corpus pipeline: each calls one operator with production parameters.

A stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``docs`` (the last one
its token rows). Filtering stages keep every row that the operator does not reject.

All stages take any columns beside ``doc_id`` and ``text``, whatever their names, and give
them back as they were. A null or empty text is a clean document: it is kept by the filters,
linked to its like by near-dedup (one of them stays), and has no ids. A null ``doc_id`` stays null.
Repeated rows are judged each by itself, but near-dedup keeps one row of them. An empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, pii, simhash
from . import toxicity as tox
from .common import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return tox.clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every selected personal-data span becomes its kind's mark; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian 32 bits) of every document."""
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids")
