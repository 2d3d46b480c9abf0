"""Vocabulary with document-frequency bounds and bag of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_scalars, materialize, number_rows


def document_frequencies(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """df(term) = number of documents containing the term (partial aggregate per term)."""
    return (docs.select(F.explode(F.array_distinct(tokens_col)).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def vocabulary(docs: DataFrame, tokens_col: str = "tokens", no_below: int = 5,
               no_above: float = 0.5, keep_n: int | None = None) -> DataFrame:
    """Terms with no_below <= df <= floor(no_above * N_docs); with ``keep_n`` only that
    many of the most frequent (df desc, term asc). By default no term is dropped.
    """
    n_docs = docs.agg(F.count(F.lit(1)).alias("_n"))
    dfreq = attach_scalars(document_frequencies(docs, tokens_col), n_docs)
    kept = dfreq.filter((F.col("df") >= no_below) & (F.col("df") <= F.floor(F.col("_n") * no_above)))
    kept = kept.select("term", "df")
    if keep_n is not None:
        kept = kept.orderBy(F.desc("df"), F.asc("term")).limit(keep_n)
    return kept


def require_vocabulary(vocab_terms: list) -> None:
    """Empty corpus / vocabulary guard."""
    if not vocab_terms:
        raise ValueError("no term is left in the vocabulary: the corpus is empty or the bounds exclude every term")


def bag_of_words(docs: DataFrame, vocab: DataFrame, doc_col: str, tokens_col: str = "tokens") -> DataFrame:
    """C8 (doc2bow, long form): (doc, term, count) for in-vocabulary terms.

    The vocabulary is joined, not collected; AQE broadcasts it when small.
    """
    ex = docs.select(doc_col, F.explode(tokens_col).alias("term"))
    return (ex.join(vocab.select("term"), "term", "left_semi")
            .groupBy(doc_col, "term").agg(F.count(F.lit(1)).alias("count")))


def numbered_vocabulary(vocab: DataFrame) -> tuple:
    """``vocab_df`` [term_id, term], numbered by df (desc) and term, and the terms in that order as an
    Arrow array.

    The term list is the model's state: it and the topic weights (k rows of that width)
    are driver objects by design. The numbering is made by ranges, in parallel.
    """
    vocab_df = materialize(number_rows(vocab.select("term", "df"), F.desc("df"), F.asc("term"), name="term_id").select(
        F.col("term_id").cast("int").alias("term_id"), "term"))
    table = vocab_df.toArrow().sort_by("term_id")
    if not len(table):
        require_vocabulary([])
    return vocab_df, table.column("term").combine_chunks()
