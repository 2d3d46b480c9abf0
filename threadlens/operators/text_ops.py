"""Text-field operators.

Everything is a native expression per row but the lemma lookup, which is one
join; the planner decides from measured sizes whether to broadcast the table.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import COMMENT_TEXT_CANDIDATES, POST_TEXT_CANDIDATES, first_existing
from ..functions.stopwords import NLTK_ENGLISH, topic_stopwords
from ..functions.text import count_words, is_blank, topic_clean
from .common import materialize


def raw_text_fields(df: DataFrame) -> DataFrame:
    """post_text_raw, comment_text_raw, text_raw (comment unless blank, else post).

    With both title and body: strip(title + " " + body), NULL -> "". With only
    a body: the body. Without a comment column: "".
    """
    cols = set(df.columns)
    if {"post_title", "post_body"} <= cols:
        post = F.regexp_replace(
            F.concat(F.coalesce("post_title", F.lit("")), F.lit(" "), F.coalesce("post_body", F.lit(""))),
            r"(?U)^\s+|\s+$", "")
    elif "post_body" in cols:
        post = F.coalesce("post_body", F.lit(""))
    else:
        post = F.lit("")
    comment = F.coalesce("comment_body", F.lit("")) if "comment_body" in cols else F.lit("")
    out = df.withColumn("post_text_raw", post).withColumn("comment_text_raw", comment)
    return out.withColumn("text_raw", F.when(is_blank("comment_text_raw"), F.col("post_text_raw")).otherwise(F.col("comment_text_raw")))


def sentiment_text(df: DataFrame) -> DataFrame:
    """Best comment text column, blank -> best post text column."""
    c = first_existing(df, COMMENT_TEXT_CANDIDATES)
    p = first_existing(df, POST_TEXT_CANDIDATES)
    ctext = F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    ptext = F.coalesce(F.col(p).cast("string"), F.lit("")) if p else F.lit("")
    return df.withColumn("sentiment_text", F.when(is_blank(ctext), ptext).otherwise(ctext))


def topic_tokens(df: DataFrame, text_col: str, out: str = "tokens", stopwords=None,
                 min_len: int = 2, max_len: int = 15) -> DataFrame:
    """C3 + C4 + C5: topic cleaning, tokenising, stopword removal (order and repeats kept).

    After C3 the text holds only lower-case ASCII letters separated by single
    spaces, so the alphabetic-run tokeniser reduces to a split on " ". Stopwords
    go through ``StopWordsRemover`` (a JVM hash-set lookup per token).
    """
    stop = topic_stopwords() if stopwords is None else list(stopwords)
    toks = F.split(topic_clean(text_col), " ")
    toks = F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len))
    tmp = f"_{out}_all"
    staged = df.withColumn(tmp, toks)
    remover = StopWordsRemover(inputCol=tmp, outputCol=out, stopWords=stop, caseSensitive=True)
    return remover.transform(staged).drop(tmp)


def alpha_tokens(text) -> F.Column:
    """Alphabetic runs of a cleaned text (the tokens the lemma step keeps)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]+"), 0)


# Bytes of a lemma table that a task may hold.
HELD_BYTES = 64 << 20


def _lemmas_in_rows(df: DataFrame, lemmas: DataFrame, out: str) -> DataFrame:
    """``df`` with its ``_toks`` replaced by ``out``; a token's lemma is looked up where the row stands."""
    held = df.sparkSession.sparkContext.broadcast([tuple(r) for r in lemmas.select("_t", "_l").toLocalIterator()])
    names = [c for c in df.columns if c != "_toks"]
    at = df.columns.index("_toks")

    def work(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, values = (pa.array([r[i] for r in held.value], pa.string()) for i in (0, 1))
        for batch in batches:
            toks = batch.column(at)
            flat = toks.flatten()
            words = pc.coalesce(values.take(pc.index_in(flat, value_set=terms)), flat)
            sizes = pc.fill_null(pc.list_value_length(toks), 0).to_pylist()
            ends = [0]
            for n in sizes:
                ends.append(ends[-1] + n)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ")
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, text], names=[*names, out])

    kept = df.drop("_toks")
    return df.select(*df.columns).mapInArrow(work, kept.withColumn(out, F.lit("")).schema)


def lemma_text(df: DataFrame, text_col: str, out: str = "text_lem",
               stopwords=None, lemmas: DataFrame | None = None) -> DataFrame:
    """Alphabetic tokens that are not stopwords, lemma (lower-cased), joined by " ".

    ``lemmas`` is a (term, lemma) table; terms missing from it keep their
    lower-cased form, a term that stands there twice gets its smallest lemma. The tagger-based lemmatiser of the reference is not
    available on Spark, so the dictionary is pluggable.
    """
    stop = list(NLTK_ENGLISH if stopwords is None else stopwords)
    # On C1-cleaned (ASCII) text, lower-casing the text first gives the same
    # tokens as lower-casing each token; stopwords go through a hash set.
    src = F.col(text_col) if isinstance(text_col, str) else text_col
    df = df.withColumn("_alpha", alpha_tokens(F.lower(src)))
    df = StopWordsRemover(inputCol="_alpha", outputCol="_toks", stopWords=stop, caseSensitive=True) \
        .transform(df).drop("_alpha")
    toks = F.col("_toks")
    if lemmas is None:
        return df.withColumn(out, F.array_join(toks, " ")).drop("_toks")
    lt = lemmas.groupBy(F.lower("term").alias("_t")).agg(F.min(F.lower("lemma")).alias("_l")).where("_l is not null")
    size = lt.agg(F.coalesce(F.sum(F.octet_length("_t") + F.octet_length("_l") + 32), F.lit(0)).alias("b")).first().b
    if size <= HELD_BYTES:
        return _lemmas_in_rows(df, lt, out)
    # A larger table is joined: a row per token, tokens put back in order by a row number of
    # their own (document keys may repeat or be NULL).
    kept = materialize(df.withColumn("_rid", F.monotonically_increasing_id()))
    ex = kept.select("_rid", F.posexplode("_toks").alias("_p", "_t"))
    j = ex.join(lt, "_t", "left").select("_rid", "_p", F.coalesce("_l", "_t").alias("_w"))
    rebuilt = j.groupBy("_rid").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_p", "_w"))), lambda s: s["_w"]), " ").alias(out))
    return (kept.drop("_toks").join(rebuilt, "_rid", "left").withColumn(out, F.coalesce(out, F.lit("")))
                .drop("_rid"))


def top_words(df: DataFrame, text_col: str, n: int = 15, stopwords=()) -> DataFrame:
    """C10 + H6 (global): the ``n`` most frequent ``[a-z']+`` words of length >= 3
    (ties -> word order)."""
    w = df.select(F.explode(count_words(text_col)).alias("word")).filter(F.length("word") >= 3)
    if stopwords:
        w = w.filter(~F.col("word").isin(list(stopwords)))
    return (w.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("word")).limit(n))


def term_freq_by_group(df: DataFrame, group_col: str, tokens_col: str, n: int = 100) -> DataFrame:
    """F41 + H6: per group, the ``n`` most frequent terms (word-cloud weights).

    Term counts are reduced per (group, term) first; the ``row_number <= n``
    filter becomes a partial window-group limit before the shuffle.
    """
    tf = (df.select(group_col, F.explode(tokens_col).alias("term"))
          .groupBy(group_col, "term").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(group_col).orderBy(F.desc("n"), F.asc("term"))
    return tf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
