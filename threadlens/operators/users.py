"""User activity.

The top-user list is an ``orderBy().limit(n)`` (distributed top-k) whose
size is bounded by ``n``, which is what makes broadcasting it for the
semi-join safe. Per-user word counts are reduced per (user, word) before the
per-user top-k, and that top-k is a ``row_number <= k`` filter that Spark
turns into a partial WindowGroupLimit below the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import null_bucket
from ..functions.text import count_words, format_word_counts
from .common import materialize
from .distributions import user_counts


def top_users(df: DataFrame, user_col: str, n: int = 20) -> DataFrame:
    """I4: the ``n`` most active users (ties -> user order)."""
    return user_counts(df, user_col).orderBy(F.desc("n_posts"), F.asc("user")).limit(n)


def top_users_profile(df: DataFrame, user_col: str, topic_col: str | None, subtopic_col: str | None,
                      text_col: str | None, n: int = 20, n_words: int = 20) -> DataFrame:
    """L2 + G7: profile of the top-``n`` users: n_posts, topic and subtopic share
    maps, top words. NULL users are bucketed as "UNKNOWN" on both sides.

    Plan: the top list is a bounded ``limit(n)``, stored once (broadcast for the
    semi-join and the final join). One scan explodes a row's topic key, subtopic
    key and words together; one aggregate counts them and is stored. Shares are
    windows over (user, topic) cells; words are ranked apart, with a plain
    ``rk <= n`` that Spark turns into a partial window-group limit.
    """
    top = materialize(top_users(df, user_col, n))
    rows = df.withColumn("user", null_bucket(user_col, "UNKNOWN")).join(
        F.broadcast(top.select("user")), "user", "left_semi")

    def tagged(kind: str, key):
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))

    parts = [F.array(tagged(kind, F.col(c))) for kind, c in (("topic", topic_col), ("subtopic", subtopic_col)) if c]
    if text_col:
        words = F.filter(count_words(text_col), lambda w: F.length(w) >= 3)
        parts.append(F.transform(words, lambda w: tagged("word", w)))
    if not parts:
        return top
    long = rows.select("user", F.explode(F.concat(*parts)).alias("e")).select("user", "e.kind", "e.key")
    cnt = materialize(long.filter(F.col("key").isNotNull()).groupBy("user", "kind", "key")
                          .agg(F.count(F.lit(1)).alias("c")))
    out = top
    per = Window.partitionBy("user", "kind")
    cells = cnt.filter(F.col("kind") != "word").withColumn("share", F.col("c") / F.sum("c").over(per))

    def entries(kind):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "share"))))

    maps = [F.map_from_entries(entries(kind)).alias(f"{kind}_dist")
            for kind, c in (("topic", topic_col), ("subtopic", subtopic_col)) if c]
    if maps:
        # At most n users on both sides.
        out = out.join(F.broadcast(cells.groupBy("user").agg(*maps)), "user", "left")
        # A top user without any key has empty maps once something of theirs was counted.
        seen = cnt.select("user").distinct().withColumn("_seen", F.lit(True))
        out = out.join(F.broadcast(seen), "user", "left")
        for m in (f"{kind}_dist" for kind, c in (("topic", topic_col), ("subtopic", subtopic_col)) if c):
            empty = F.when(F.col("_seen"), F.expr("map_from_entries(cast(array() as array<struct<key:string,share:double>>))"))
            out = out.withColumn(m, F.coalesce(m, empty))
        out = out.drop("_seen")
    if text_col:
        order = Window.partitionBy("user").orderBy(F.desc("c"), F.asc("key"))
        best = cnt.filter("kind = 'word'").withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= n_words)
        words = F.array_sort(F.collect_list(F.struct("rk", "key", "c")))
        lists = best.groupBy("user").agg(format_word_counts(F.transform(words, lambda w: F.struct(
            w["key"].alias("word"), w["c"].alias("count")))).alias("top_words"))
        out = out.join(F.broadcast(lists), "user", "left").withColumn("top_words", F.coalesce("top_words", F.lit("")))
    return out


def empty_profile(spark) -> DataFrame:
    """L2 with no user column: empty frame with the declared schema."""
    return spark.createDataFrame([], "user string, n_posts long, topic_dist map<string,double>, "
                                     "subtopic_dist map<string,double>, top_words string")
