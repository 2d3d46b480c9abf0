"""Registered queries for column roles and times under other names and types (A5, A6, B9, J6, K1),
a draw that both engines repeat (I7), and the subtopic gates (B7, B8, J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import columns as C
from ..functions import timeaxis as TA
from ..operators import text_ops as TO
from ..operators import topics as TP
from ..sources import io as IO
from ..sources.tables import comments, docs, read_table
from .registry import register
from .textual import TOKS

# One table under two sets of names: times as epoch seconds with gaps, and as texts of which some are no dates.
_SHAPES = """epoch AS (
  SELECT o_orderkey AS "postId", CASE WHEN o_orderkey % 7 <> 0 THEN epoch(CAST(o_orderdate AS TIMESTAMP)) END AS created_utc,
         CAST(o_custkey AS VARCHAR) AS username, substr(o_orderpriority, 1, 1) AS topic FROM orders),
texts AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS "timestamp",
         CAST(o_custkey AS VARCHAR) AS author, CAST(o_custkey % 4 AS INTEGER) AS comment_subtopic FROM orders)"""


def _shape(o, kind: str):
    if kind == "epoch":
        seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
        return o.select(F.col("o_orderkey").alias("postId"), F.when(F.col("o_orderkey") % 7 != 0, seconds).alias("created_utc"),
                        F.col("o_custkey").cast("string").alias("username"), F.substring("o_orderpriority", 1, 1).alias("topic"))
    said = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 == 0, "no date").otherwise(said).alias("timestamp"),
                    F.col("o_custkey").cast("string").alias("author"), (F.col("o_custkey") % 4).cast("int").alias("comment_subtopic"))


@register("roles_and_times", f"""WITH {_SHAPES},
u AS (SELECT 'epoch' AS shape, year(make_timestamp(CAST(created_utc * 1000000 AS BIGINT))) AS year, "postId" AS post, username AS who,
             topic, -1 AS subtopic FROM epoch
      UNION ALL SELECT 'texts', year(TRY_CAST("timestamp" AS TIMESTAMP)), id, author, 'none', comment_subtopic FROM texts)
SELECT shape, CAST(year AS INTEGER) AS year, count(*) AS n, count(DISTINCT post) AS posts, count(DISTINCT who) AS users,
       count(DISTINCT topic) AS topics, CAST(sum(subtopic) AS BIGINT) AS subtopics FROM u GROUP BY 1, 2""")
def q_roles_and_times(spark, sf):
    """The same counts from two tables of other column names and time types; what
    has no column gets its default, what is no time goes to the NULL year."""
    out = None
    for kind in ("epoch", "texts"):
        df = _shape(read_table(spark, sf, "orders"), kind)
        time = C.require_one(df, C.TIME_CANDIDATES, "time")
        who, post = C.require_one(df, C.USER_CANDIDATES, "user"), C.require_one(df, C.POST_KEY_CANDIDATES, "post")
        df = C.with_default(df, "topic_id", "none", C.TOPIC_CANDIDATES)
        df = C.with_default(df, "comment_subtopic", -1)
        one = df.groupBy(F.lit(kind).alias("shape"), TA.year_of(TA.coerce_time(df, time)).alias("year")).agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct(post).alias("posts"), F.count_distinct(who).alias("users"),
            F.count_distinct("topic_id").alias("topics"), F.sum("comment_subtopic").cast("long").alias("subtopics"))
        out = one if out is None else out.unionByName(one)
    return out


_KEY = ["post_id", "l_linenumber", "comment_id", "l_suppkey"]


@register("seeded_draw", """WITH k AS (SELECT l_orderkey AS post_id, l_linenumber, l_partkey AS comment_id, l_suppkey, md5(concat_ws(':', 42,
  l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS h FROM lineitem)
SELECT post_id, l_linenumber, comment_id, l_suppkey FROM k ORDER BY h, post_id, l_linenumber, comment_id, l_suppkey LIMIT 9""")
def q_seeded_draw(spark, sf):
    """Rows drawn by the hash of seed and key, the same in any engine and order."""
    return IO.draw(comments(spark, sf).select(*_KEY), 9, 42, *_KEY)


@register("topic_gates", f"""WITH documents AS (
  SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text,
         CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '-1' ELSE lang || doc_id % 7 END AS lang FROM documents),
{TOKS}
SELECT d.lang AS main, count(*) AS n_all, CAST(sum(CASE WHEN len(t) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_tok
FROM toks JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL AND d.lang <> '-1' AND trim(coalesce(d.text, '')) <> ''
GROUP BY 1 HAVING n_all >= 30 AND n_tok >= 30""")
def q_topic_gates(spark, sf):
    """The main topics that are large enough for subtopics of their own."""
    lang = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "-1").otherwise(
        F.concat("lang", (F.col("doc_id") % 7).cast("string")))
    d = docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text")).alias("text"), lang.alias("main"))
    d = TP.gated_texts(d, "main", "text")
    toks = TO.topic_tokens(d, "text").select(F.col("main").alias("_main"), "tokens")
    return TP.eligible_groups(toks, 30).select(F.col("_main").alias("main"), "n_all", "n_tok")
