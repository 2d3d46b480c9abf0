"""The role bindings of ``sources.tables`` written as DuckDB CTEs for the oracles."""

COMMENTS = """comments AS (
  SELECT l_orderkey AS post_id, l_partkey AS comment_id, l_shipdate AS comment_created_utc,
         CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS comment_subtopic,
         round(l_discount - 0.05, 4) AS vader_compound,
         CASE WHEN round(l_discount - 0.05, 4) >= 0.02 THEN 'positive'
              WHEN round(l_discount - 0.05, 4) <= -0.02 THEN 'negative' ELSE 'neutral' END AS vader_label,
         CASE WHEN l_tax = 0.08 THEN NULL WHEN l_returnflag = 'R' THEN 'negative'
              WHEN l_returnflag = 'N' THEN 'neutral' WHEN l_returnflag = 'A' THEN 'positive' END AS bert_label,
         round(l_quantity / 50.0, 4) AS bert_score,
         l_linenumber, l_suppkey, l_returnflag, l_discount, l_extendedprice, l_quantity
  FROM lineitem)"""

POSTS = """posts AS (
  SELECT o_orderkey AS post_id, o_orderdate AS post_created_utc,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS topic_id, o_orderpriority AS topic_name,
         CAST(o_custkey AS VARCHAR) AS author, o_orderstatus AS subreddit, o_totalprice AS post_score
  FROM orders)"""

PC = "pc AS (SELECT * FROM comments JOIN posts USING (post_id))"

ROW_ORDER = ("comment_created_utc, l_linenumber, comment_id, l_suppkey, l_returnflag, "
             "l_discount, l_extendedprice, l_quantity")


def with_comments(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([COMMENTS, *more]) + "\n" + body


def with_pc(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([COMMENTS, POSTS, PC, *more]) + "\n" + body
