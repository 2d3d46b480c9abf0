"""Corpus assembly re-aimed on tables.

The reference crawls a forum per (community, sort order) and keeps each post
the first time it is seen. Here the candidate posts are a table: each sort
order is a ``row_number() <= n`` per source (Spark turns that filter into a
partial window-group limit, so a hot source is cut to n rows per map task
before the shuffle), the orders are unioned, and first-seen is a ``min_by``
aggregate per post over (source order, method order, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sort methods in crawl order.
SORT_METHODS = ["relevance", "top", "new"]


def keyword_query(keywords) -> str:
    """Quote multi-word phrases, join with OR."""
    return " OR ".join(f'"{k}"' if " " in k else k for k in keywords)


def _kw_regex(k: str) -> str:
    import re
    return r"(?i)\b" + re.escape(k) + r"\b"


# Parts a source is ranked in before its own ranking.
SALTS = 64


def keyword_hits(text, keywords) -> Column:
    """Number of keywords (case-insensitive, whole words/phrases) occurring in ``text``."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return sum((t.rlike(_kw_regex(k)).cast("int") for k in keywords), F.lit(0))


def keyword_filter(df: DataFrame, text: str, keywords) -> DataFrame:
    """B5 as a predicate: rows matching any keyword."""
    return df.filter(keyword_hits(text, keywords) > 0)


def distinct_sources(df: DataFrame, source_col: str) -> DataFrame:
    """Case-insensitive distinct source names."""
    return df.select(F.lower(source_col).alias("source")).distinct()


def top_per_source(posts: DataFrame, source_col: str, method: str, n: int, measures: dict) -> DataFrame:
    """H5: the ``n`` best posts of every source under one sort method.

    The best of each salted part of a source go to the source's own ranking, so a
    source with any share of all posts is ranked by many tasks first.
    """
    order = measures[method]
    part = Window.partitionBy(source_col, "_salt").orderBy(*order)
    whole = Window.partitionBy(source_col).orderBy(*order)
    salted = posts.withColumn("_salt", F.pmod(F.xxhash64(*posts.columns), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= n).drop("rank", "_salt")
    return (first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= n)
            .withColumn("method", F.lit(method)))


def assemble(posts: DataFrame, post_col: str, source_col: str, n: int, measures: dict,
             methods=SORT_METHODS) -> DataFrame:
    """A8 + J5 + G8: union of per-(source, method) top-n lists; each post kept once,
    at its first sighting in (source, method order, rank) order. ``dup_count``
    is how many later sightings were skipped."""
    parts = None
    for i, m in enumerate(methods):
        p = top_per_source(posts, source_col, m, n, measures).withColumn("method_order", F.lit(i))
        parts = p if parts is None else parts.unionByName(p)
    key = F.struct(F.lower(source_col), "method_order", "rank")
    first = parts.groupBy(post_col).agg(
        F.min_by(F.struct(source_col, "method", "rank"), key).alias("_f"),
        (F.count(F.lit(1)) - 1).alias("dup_count"))
    return first.select(post_col, "_f.*", "dup_count")


def flatten(selected: DataFrame, comments: DataFrame, post_col: str, body_col: str) -> DataFrame:
    """One row per comment of a selected post; posts without comments vanish,
    comments without a body are skipped."""
    return selected.join(comments.filter(F.col(body_col).isNotNull()), post_col, "inner")


def counters(selected: DataFrame, comments: DataFrame, post_col: str, source_col: str,
             body_col: str, sources: DataFrame | None = None) -> DataFrame:
    """A10: per (source, method) posts kept, posts that yielded comments, comment rows,
    duplicates skipped later, and an empty-source flag.

    Comments are counted per post first (partial aggregate), so the selection
    is read once and joined to one row per post.
    """
    per_post = (comments.filter(F.col(body_col).isNotNull()).groupBy(post_col)
                .agg(F.count(F.lit(1)).alias("_nc")))
    s = selected.join(per_post, post_col, "left")
    got = s.groupBy(source_col, "method").agg(
        F.count(F.lit(1)).alias("posts_kept"),
        F.sum(F.when(F.col("_nc") > 0, 1).otherwise(0)).alias("posts_with_comments"),
        F.coalesce(F.sum("_nc"), F.lit(0)).alias("comments_kept"),
        F.sum("dup_count").alias("duplicates_later"),
    )
    if sources is not None:
        # Every asked (source, method) gets a row, also one that kept no post.
        asked = sources.select(F.col(source_col), "method").distinct()
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("posts_kept", "posts_with_comments", "comments_kept",
                                                            "duplicates_later")]
        got = asked.join(got, [source_col, "method"], "left").select(source_col, "method", *zero)
    return got.withColumn("empty_source", F.col("posts_kept") == 0)


def skip_seen(new: DataFrame, seen: DataFrame, post_col: str) -> DataFrame:
    """Drop posts already collected in an earlier batch."""
    return new.join(seen.select(post_col).distinct(), post_col, "left_anti")
