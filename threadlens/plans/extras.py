"""Registered queries: users, corpus assembly, profiling, findings, IO and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as AG
from ..operators import contagion as CT
from ..operators import distributions as D
from ..operators import findings as FD
from ..operators import risk as RK
from ..operators import trends as TR
from ..operators import users as US
from ..operators.common import materialize
from ..sources import collect as CO
from ..sources import io as IO
from ..sources.tables import ROW_ORDER, comments, conv_raw, docs, posts, posts_comments, read_table
from ..streaming import live as LV
from .aggregates import sub_dist, topic_dist
from .registry import finish, register
from .sqlbind import ROW_ORDER as SQL_ORDER
from .sqlbind import with_comments, with_pc

# ------------------------------------------------------------------ F36 / F37 / L2


@register("user_counts", with_pc("SELECT coalesce(author, 'UNKNOWN') AS user, count(*) AS n_posts FROM pc GROUP BY 1"))
def q_user_counts(spark, sf):
    return D.user_counts(posts_comments(spark, sf), "author")


@register("user_histogram", with_pc("""
SELECT CAST(g.bin AS INTEGER) AS bin, round(b.lo + g.bin * b.w, 6) AS bin_start, round(b.lo + (g.bin + 1) * b.w, 6) AS bin_end,
       coalesce(c.n, 0) AS n
FROM range(50) g(bin)
CROSS JOIN (SELECT lo, (hi - lo) / 50 AS w FROM (
  SELECT CASE WHEN min(n_posts) = max(n_posts) THEN min(n_posts) - 0.5 ELSE min(n_posts) END * 1.0 AS lo,
         CASE WHEN min(n_posts) = max(n_posts) THEN max(n_posts) + 0.5 ELSE max(n_posts) END * 1.0 AS hi FROM uc)) b
LEFT JOIN (SELECT least(CAST(floor((n_posts - b2.lo) / b2.w) AS INTEGER), 49) AS bin, count(*) AS n
           FROM uc, (SELECT lo, (hi - lo) / 50 AS w FROM (
             SELECT CASE WHEN min(n_posts) = max(n_posts) THEN min(n_posts) - 0.5 ELSE min(n_posts) END * 1.0 AS lo,
                    CASE WHEN min(n_posts) = max(n_posts) THEN max(n_posts) + 0.5 ELSE max(n_posts) END * 1.0 AS hi
             FROM uc)) b2 GROUP BY 1) c ON c.bin = g.bin""",
    "uc AS (SELECT coalesce(author, 'UNKNOWN') AS user, count(*) AS n_posts FROM pc GROUP BY 1)"))
def q_user_histogram(spark, sf):
    uc = D.user_counts(posts_comments(spark, sf), "author")
    return finish(D.histogram(uc, "n_posts", 50))


def _profile_input(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("source").alias("author"), F.col("lang").alias("topic_id"), "text")
    q = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("subtopic"))
    return d.join(q, "doc_id", "left")


def _dist_sql(key):
    return f"""(SELECT user, string_agg(k || ':' || printf('%.6f', n * 1.0 / t), ';' ORDER BY k) AS d FROM (
      SELECT user, CAST({key} AS VARCHAR) AS k, count(*) AS n, sum(count(*)) OVER (PARTITION BY user) AS t
      FROM rows WHERE {key} IS NOT NULL GROUP BY 1, 2) GROUP BY user)"""


@register("top_users_profile", f"""
WITH src AS (SELECT d.doc_id, coalesce(d.source, 'UNKNOWN') AS user, d.lang AS topic_id, l.quality AS subtopic, d.text
             FROM documents d LEFT JOIN labels l USING (doc_id)),
top AS (SELECT user, count(*) AS n_posts FROM src GROUP BY user ORDER BY n_posts DESC, user LIMIT 20),
rows AS (SELECT * FROM src WHERE user IN (SELECT user FROM top)),
words AS (SELECT user, word, count(*) AS c FROM (
            SELECT user, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM rows)
          WHERE length(word) >= 3 GROUP BY 1, 2),
tw AS (SELECT user, string_agg(word || ':' || c, ';' ORDER BY rk) AS top_words FROM (
         SELECT *, row_number() OVER (PARTITION BY user ORDER BY c DESC, word) AS rk FROM words) WHERE rk <= 20
       GROUP BY user)
SELECT top.user, top.n_posts, td.d AS topic_dist, sd.d AS subtopic_dist, coalesce(tw.top_words, '') AS top_words
FROM top LEFT JOIN {_dist_sql('topic_id')} td USING (user) LEFT JOIN {_dist_sql('subtopic')} sd USING (user)
LEFT JOIN tw USING (user)""")
def q_top_users_profile(spark, sf):
    prof = US.top_users_profile(_profile_input(spark, sf), "author", "topic_id", "subtopic", "text", 20, 20)

    def render(m):
        # an empty share map (no non-null keys) renders as NULL, like an empty string_agg
        return F.when(F.size(m) > 0, F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(
            e["key"], F.lit(":"), F.format_string("%.6f", e["value"]))), ";"))
    return prof.select("user", "n_posts", render("topic_dist").alias("topic_dist"),
                       render("subtopic_dist").alias("subtopic_dist"), "top_words")


@register("event_user_counts", "SELECT coalesce(CAST(user_id AS VARCHAR), 'UNKNOWN') AS user, count(*) AS n_posts FROM events GROUP BY 1")
def q_event_user_counts(spark, sf):
    """F36 on the event stream (user = user_id)."""
    return D.user_counts(read_table(spark, sf, "events"), "user_id")


# ------------------------------------------------------------------ A8-A10, B5, H5, J1, G8

KEYWORDS = ["urgent", "high", "not specified"]
N_PER_SOURCE = 1000


def _candidates(spark, sf):
    """Posts matching the keyword query (B5), with their hit counts for relevance order."""
    p = posts(spark, sf)
    return p.withColumn("hits", CO.keyword_hits("topic_name", KEYWORDS)).filter(F.col("hits") > 0)


def measures():
    """Sort orders standing in for the forum's relevance / top / new listings."""
    return {
        "relevance": [F.desc("hits"), F.desc("post_score"), F.asc("post_id")],
        "top": [F.desc("post_score"), F.asc("post_id")],
        "new": [F.desc("post_created_utc"), F.asc("post_id")],
    }

_SEL_SQL = f"""cand AS (
  SELECT post_id, subreddit, post_score, post_created_utc,
         (CASE WHEN regexp_matches(topic_name, '(?i)\\burgent\\b') THEN 1 ELSE 0 END +
          CASE WHEN regexp_matches(topic_name, '(?i)\\bhigh\\b') THEN 1 ELSE 0 END +
          CASE WHEN regexp_matches(topic_name, '(?i)\\bnot\\ specified\\b') THEN 1 ELSE 0 END) AS hits FROM posts
  WHERE regexp_matches(topic_name, '(?i)\\burgent\\b') OR regexp_matches(topic_name, '(?i)\\bhigh\\b')
     OR regexp_matches(topic_name, '(?i)\\bnot\\ specified\\b')),
ranked AS (
  SELECT post_id, subreddit, 'relevance' AS method, 0 AS method_order,
         row_number() OVER (PARTITION BY subreddit ORDER BY hits DESC, post_score DESC, post_id) AS rank FROM cand
  UNION ALL
  SELECT post_id, subreddit, 'top', 1, row_number() OVER (PARTITION BY subreddit ORDER BY post_score DESC, post_id) FROM cand
  UNION ALL
  SELECT post_id, subreddit, 'new', 2, row_number() OVER (PARTITION BY subreddit ORDER BY post_created_utc DESC, post_id) FROM cand),
sel AS (
  SELECT post_id, subreddit, method, rank, dup_count FROM (
    SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY lower(subreddit), method_order, rank) AS rn,
           count(*) OVER (PARTITION BY post_id) - 1 AS dup_count
    FROM ranked WHERE rank <= {N_PER_SOURCE}) WHERE rn = 1)"""


def _selected(spark, sf):
    return CO.assemble(_candidates(spark, sf), "post_id", "subreddit", N_PER_SOURCE, measures())


@register("collect_top_per_source", with_pc("SELECT post_id, subreddit, method, CAST(rank AS INTEGER) AS rank, dup_count FROM sel", _SEL_SQL))
def q_collect_top_per_source(spark, sf):
    return _selected(spark, sf)


def _comment_rows(spark, sf):
    return comments(spark, sf).select("post_id", "comment_id", F.col("bert_label").alias("comment_body"))


@register("collect_flatten", with_pc("""
SELECT s.post_id, s.subreddit, s.method, count(*) AS n_comments
FROM sel s JOIN comments c USING (post_id) WHERE c.bert_label IS NOT NULL GROUP BY 1, 2, 3""", _SEL_SQL))
def q_collect_flatten(spark, sf):
    flat = CO.flatten(_selected(spark, sf), _comment_rows(spark, sf), "post_id", "comment_body")
    return flat.groupBy("post_id", "subreddit", "method").agg(F.count(F.lit(1)).alias("n_comments"))


@register("collect_counters", with_pc("""
SELECT subreddit, method, count(*) AS posts_kept,
       CAST(sum(CASE WHEN nc > 0 THEN 1 ELSE 0 END) AS BIGINT) AS posts_with_comments,
       CAST(coalesce(sum(nc), 0) AS BIGINT) AS comments_kept, CAST(sum(dup_count) AS BIGINT) AS duplicates_later,
       count(*) = 0 AS empty_source
FROM sel LEFT JOIN (SELECT post_id, count(*) AS nc FROM comments WHERE bert_label IS NOT NULL GROUP BY 1) USING (post_id)
GROUP BY 1, 2""", _SEL_SQL))
def q_collect_counters(spark, sf):
    out = CO.counters(_selected(spark, sf), _comment_rows(spark, sf), "post_id", "subreddit", "comment_body")
    return out.select("subreddit", "method", F.col("posts_kept").cast("long"), F.col("posts_with_comments").cast("long"),
                      F.col("comments_kept").cast("long"), F.col("duplicates_later").cast("long"), "empty_source")


@register("keyword_filter", """
SELECT lang, count(*) AS n_docs FROM documents
WHERE regexp_matches(text, '(?i)\\bwith\\b') OR regexp_matches(text, '(?i)\\bthe\\ of\\b') GROUP BY 1""")
def q_keyword_filter(spark, sf):
    """Documents matching any keyword / quoted phrase."""
    return CO.keyword_filter(docs(spark, sf), "text", ["with", "the of"]).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"))


@register("distinct_sources", "SELECT DISTINCT lower(source) AS source FROM documents")
def q_distinct_sources(spark, sf):
    return CO.distinct_sources(read_table(spark, sf, "documents"), "source")


@register("skip_seen_posts", """
SELECT count(*) AS n_new FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'F') n
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def q_skip_seen_posts(spark, sf):
    """Posts of a new batch (status != F) not seen in an earlier one (status = O)."""
    p = posts(spark, sf)
    new = p.filter(F.col("subreddit") != "F").select("post_id").distinct()
    seen = p.filter(F.col("subreddit") == "O")
    return CO.skip_seen(new, seen, "post_id").agg(F.count(F.lit(1)).alias("n_new"))


# ------------------------------------------------------------------ A2 / A7 / I7

@register("table_profile", with_pc("""
SELECT count(*) AS n_rows, count(DISTINCT post_id) AS n_posts, count(DISTINCT comment_id) AS n_comment_ids,
       count(bert_label) AS nonnull_bert_label, count(comment_subtopic) AS nonnull_comment_subtopic,
       count(author) AS nonnull_author FROM pc"""))
def q_table_profile(spark, sf):
    """Row count, distinct post / comment ids, non-null counts."""
    pc = posts_comments(spark, sf)
    return pc.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("post_id").alias("n_posts"),
                  F.count_distinct("comment_id").alias("n_comment_ids"),
                  F.count("bert_label").alias("nonnull_bert_label"),
                  F.count("comment_subtopic").alias("nonnull_comment_subtopic"),
                  F.count("author").alias("nonnull_author"))


_PROFILE_COLS = [("post_id", "bigint", "BIGINT"), ("comment_id", "bigint", "BIGINT"), ("bert_label", "string", "VARCHAR"),
                 ("vader_label", "string", "VARCHAR")]


@register("column_profile", with_comments(" UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows, count({c}) AS n_nonnull FROM comments"
    for i, (c, t, _) in enumerate(_PROFILE_COLS))))
def q_column_profile(spark, sf):
    """Every column's type and non-null count."""
    return IO.profile(comments(spark, sf).select(*[c for c, _, _ in _PROFILE_COLS]))


@register("random_row")
def q_random_row(spark, sf):
    """One row chosen at random (seeded)."""
    return posts_comments(spark, sf).orderBy(F.rand(42)).limit(1)


@register("random_row_is_member", "SELECT CAST(1 AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_found")
def q_random_row_is_member(spark, sf):
    """The row drawn is one row, and one of the table's."""
    pc = comments(spark, sf)
    row = pc.orderBy(F.rand(42)).limit(1)
    same = [pc[c].eqNullSafe(F.col(f"_{c}")) for c in pc.columns]
    drawn = row.select(*[F.col(c).alias(f"_{c}") for c in pc.columns])
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    there = drawn.join(pc, cond, "left_semi").select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = drawn.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(there)
    return both.agg(F.sum("a").alias("n_rows"), F.sum("b").alias("n_found"))


PREFIX_ROWS = 50_000


@register("prefix_scan", with_comments(f"""
SELECT bert_label AS label, count(*) AS n FROM (
  SELECT * FROM comments ORDER BY post_id, {SQL_ORDER} LIMIT {PREFIX_ROWS}) GROUP BY 1"""))
def q_prefix_scan(spark, sf):
    """A2: the reference's bounded read (first 50 000 rows in file order, here an
    explicit total order), then label counts over that prefix."""
    c = comments(spark, sf)
    pre = IO.prefix(c, PREFIX_ROWS, "post_id", *ROW_ORDER)
    return pre.groupBy(F.col("bert_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ L3 / L4 / C12

def _findings_sql():
    from .aggregates import _PAIRS, _TD_RAW, _TOPIC_CHANGE, _TOPIC_YEAR
    shares = ", ".join(f"1.0 * sum(CASE WHEN bert_label = '{v}' THEN 1 ELSE 0 END) / count(*) AS {v}"
                       for v in ("negative", "neutral", "positive"))
    ys = f"""ys AS (SELECT CAST(year(comment_created_utc) AS INTEGER) AS year, {shares}
  FROM comments WHERE comment_created_utc IS NOT NULL AND bert_label IS NOT NULL GROUP BY 1)"""
    tr = """tr AS (
  SELECT label, regr_slope(share, x) AS slope,
         CASE WHEN var_samp(share) = 0 THEN 0.0 ELSE corr(x, share) * corr(x, share) END AS r2,
         CASE WHEN regr_slope(share, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
         arg_min(share, x) AS st, arg_max(share, x) AS en
  FROM (SELECT CAST(year AS DOUBLE) AS x, 'positive' AS label, positive AS share FROM ys
        UNION ALL SELECT CAST(year AS DOUBLE), 'negative', negative FROM ys
        UNION ALL SELECT CAST(year AS DOUBLE), 'neutral', neutral FROM ys)
  GROUP BY label HAVING count(*) > 1)"""
    gl = """gl AS (
  SELECT * FROM (SELECT 'gaining' AS side, topic, last_share - first_share AS change FROM tc
                 ORDER BY last_share - first_share DESC, topic ASC LIMIT 3)
  UNION ALL
  SELECT * FROM (SELECT 'losing' AS side, topic, last_share - first_share AS change FROM tc
                 ORDER BY last_share - first_share ASC, topic DESC LIMIT 3))"""
    cr = """cr AS (SELECT CASE WHEN count(*) > 10 THEN corr(post_score, avg_comment_score) END AS r,
                  regr_slope(avg_comment_score, post_score) AS slope FROM pp)"""
    body = """
SELECT 'topic_prevalence' AS question, side AS metric, 'topic ' || topic AS subject, round(change, 6) AS value,
       'Topic ' || topic || ': ' || printf('%+.1f%%', round(change * 100, 1)) AS text FROM gl
UNION ALL
SELECT 'post_comment', 'pearson_r',
       CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END, round(r, 6),
       'r = ' || printf('%.3f', round(r, 3)) || ', slope = ' || printf('%.4f', round(slope, 4)) || ' (' ||
       CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END || ' ' ||
       CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END || ')' FROM cr
UNION ALL
SELECT * FROM (SELECT 'high_risk', 'top_negative_bert', 'topic ' || topic, round(bert_neg_pct, 6),
       'Topic ' || topic || ': ' || printf('%.1f%%', round(bert_neg_pct * 100, 1)) || ' of ' || format('{:,}', n_rows)
       FROM td ORDER BY bert_neg_pct DESC, topic LIMIT 5)
UNION ALL
SELECT 'sentiment_trend', 'bert_' || label, direction, round(slope, 6),
       printf('%.1f%%', round(st * 100, 1)) || ' to ' || printf('%.1f%%', round(en * 100, 1)) || ', slope ' ||
       printf('%.4f', round(slope, 4)) || '/yr, R2 ' || printf('%.3f', round(r2, 3)) FROM tr"""
    from .sqlbind import with_pc
    return with_pc(body, _TOPIC_YEAR, _TOPIC_CHANGE, gl, _PAIRS, cr, _TD_RAW, ys, tr)


@register("findings_rows", _findings_sql())
def q_findings_rows(spark, sf):
    """L3 + L4 + C12: the three research questions and trend findings as report rows."""
    pc = posts_comments(spark, sf)
    ty = D.topic_share_by_period(pc, "year", "comment_created_utc", "topic_id")
    gl = TR.gain_loss_top(TR.topic_change(ty))
    corr = CT.post_comment_correlation(CT.post_comment_pairs(comments(spark, sf), "bert_label", ROW_ORDER))
    risk = RK.top_negative_topics(topic_dist(spark, sf), "bert", 5)
    tr = TR.label_trends(D.label_share_by_period(comments(spark, sf), "bert_label", "year"))
    return finish(FD.findings_table(FD.prevalence_findings(gl), FD.contagion_findings(corr),
                                    FD.risk_findings(risk), FD.trend_findings(tr, "bert")))


def _full_findings_sql():
    """The nine questions' numbers as rows (question, model, metric, subject, value)."""
    from ..functions.stats import pearson_p_sql
    from .aggregates import _MONTHLY, _PAIRS, _SD_RAW, _TD_RAW, _TOPIC_CHANGE, _TOPIC_YEAR
    labels, models = ("negative", "neutral", "positive"), (("bert", "bert_label"), ("vader", "vader_label"))
    parts, ctes = [], [_TOPIC_YEAR, _TOPIC_CHANGE, _TD_RAW, _SD_RAW, _MONTHLY]
    row = lambda q, m, metric, subject, value, rest: (
        f"SELECT '{q}' AS question, '{m}' AS model, {metric} AS metric, {subject} AS subject, "
        f"round(CAST({value} AS DOUBLE), 6) AS value FROM {rest}")
    for m, c in models:
        shares = ", ".join(f"1.0 * sum(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END) / count(*) AS {v}" for v in labels)
        ctes.append(f"ys_{m} AS (SELECT CAST(year(comment_created_utc) AS INTEGER) AS year, {shares} FROM comments "
                    f"WHERE comment_created_utc IS NOT NULL AND {c} IS NOT NULL GROUP BY 1)")
        ctes.append(f"tr_{m} AS (SELECT label, regr_slope(share, x) AS slope, arg_min(share, x) AS st, "
                    f"arg_max(share, x) AS en, CASE WHEN var_samp(share) = 0 THEN 0.0 ELSE corr(x, share) END AS r, "
                    "count(*) AS n FROM (" + " UNION ALL ".join(
                        f"SELECT CAST(year AS DOUBLE) AS x, '{v}' AS label, {v} AS share FROM ys_{m}" for v in labels)
                    + ") GROUP BY label HAVING count(*) > 1)")
        q = "trend"
        for metric, value in (("slope", "slope"), ("start", "st"), ("end", "en"), ("r_squared", "r * r"),
                              ("p_value", pearson_p_sql("r", "n"))):
            parts.append(row(q, m, f"'{metric}'", "label", value, f"tr_{m}"))
        for kind, k in (("most_negative", "neg"), ("most_positive", "pos")):
            parts.append("SELECT * FROM (" + row("topics", m, f"'{kind}'", "'topic ' || topic", f"{m}_{k}_pct",
                                                 f"td ORDER BY {m}_{k}_pct DESC, topic LIMIT 1") + ")")
        parts.append(row("topics", m, "'neg_mean'", "'all topics'", f"avg({m}_neg_pct)", "td"))
        parts.append(row("topics", m, "'neg_sd'", "'all topics'", f"stddev_samp({m}_neg_pct)", "td"))
        parts.append("SELECT * FROM (" + row("subtopics", m, "'top_negative'", "printf('T%d-S%d', topic, subtopic)",
                                             f"{m}_neg_pct", f"sd ORDER BY {m}_neg_pct DESC, topic, subtopic LIMIT 5") + ")")
        parts.append("SELECT * FROM (" + row("subtopics", m, "'widest_spread'", "'topic ' || topic", "s",
                     f"(SELECT topic, stddev_samp({m}_neg_pct) AS s FROM sd GROUP BY topic) "
                     "WHERE s IS NOT NULL AND NOT isnan(s) ORDER BY s DESC, topic LIMIT 1") + ")")
        for v in labels:
            parts.append(row("models", m, "'overall_share'", f"'{v}'",
                             f"avg(CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END)", "comments"))
        ctes.append(_PAIRS.replace("pp AS", f"pp_{m} AS", 1).replace("bert_label", c))
        ctes.append(f"cr_{m} AS (SELECT CASE WHEN count(*) > 10 THEN corr(post_score, avg_comment_score) END AS r, "
                    f"count(*) AS n FROM pp_{m})")
        parts.append(row("post_comment", m, "'r'", "'all posts'", "r", f"cr_{m}"))
        parts.append(row("post_comment", m, "'p_value'", "'all posts'", pearson_p_sql("r", "n"), f"cr_{m}"))
    for side, order in (("gaining", "DESC, topic ASC"), ("losing", "ASC, topic DESC")):
        parts.append("SELECT * FROM (" + row("prevalence", "all", f"'{side}'", "'topic ' || topic", "last_share - first_share",
                                             f"tc ORDER BY last_share - first_share {order} LIMIT 3") + ")")
    ctes.append("mc AS (SELECT corr(bert_neg_pct, vader_neg_pct) AS r, count(*) AS n FROM td)")
    parts.append(row("models", "both", "'topic_r'", "'all topics'", "r", "mc"))
    parts.append(row("models", "both", "'topic_p_value'", "'all topics'", pearson_p_sql("r", "n"), "mc"))
    for name, t, key in (("topic", "td", "'topic ' || topic"), ("subtopic", "sd", "printf('T%d-S%d', topic, subtopic)")):
        order = "topic" if name == "topic" else "topic, subtopic"
        parts.append("SELECT * FROM (" + row("models", "both", f"'{name}_disagreement'", key, "abs(bert_neg_pct - vader_neg_pct)",
                                             f"{t} ORDER BY abs(bert_neg_pct - vader_neg_pct) DESC, {order} LIMIT 1") + ")")
    same = ("(SELECT topic FROM td ORDER BY bert_neg_pct DESC, topic LIMIT 1) b JOIN "
            "(SELECT topic FROM td ORDER BY vader_neg_pct DESC, topic LIMIT 1) v ON b.topic = v.topic")
    parts.append(row("models", "both", "'same_top_topic'", "'most negative'", "count(*)", same))
    for metric, value in (("slope", "regr_slope(neg_share, volume)"), ("r2", "regr_r2(neg_share, volume)"),
                          ("r", "corr(volume, neg_share)")):
        parts.append(row("volume", "bert", f"'{metric}'", "'monthly volume'", value, "mv"))
    return with_pc(" UNION ALL ".join(parts), *ctes)


@register("findings_all", _full_findings_sql())
def q_findings_all(spark, sf):
    """L3 + L4: the numbers behind all nine questions, both models, with p-values, as rows.
    The two large aggregates (topics and subtopics) are made once and read many times."""
    c = comments(spark, sf)
    td, sd = materialize(topic_dist(spark, sf)), materialize(sub_dist(spark, sf))
    ty = materialize(D.topic_share_by_period(posts_comments(spark, sf), "year", "comment_created_utc", "topic_id"))
    mv = D.monthly_volume_negative(c, "bert_label")
    topic = F.concat(F.lit("topic "), F.col("topic").cast("string"))
    cell = F.format_string("T%d-S%d", "topic", "subtopic")
    parts = []

    def add(df, question, model, subject, **values):
        parts.extend(FD.number_rows(df, question, model, subject, values))

    for m, label in (("bert", "bert_label"), ("vader", "vader_label")):
        tr = materialize(TR.label_trends(D.label_share_by_period(c, label, "year")))
        add(tr, "trend", m, F.col("label"), slope="slope", start="start", end="end", r_squared="r_squared", p_value="p_value")
        for kind, k in (("most_negative", "neg"), ("most_positive", "pos")):
            add(td.orderBy(F.desc(f"{m}_{k}_pct"), "topic").limit(1), "topics", m, topic, **{kind: f"{m}_{k}_pct"})
        add(RK.topic_neg_mean_sd(td), "topics", m, F.lit("all topics"), neg_mean=f"{m}_mean", neg_sd=f"{m}_sd")
        add(RK.top_negative_subtopics(sd, m, 5), "subtopics", m, F.col("label"), top_negative="neg_pct")
        add(RK.subtopic_spread_max(sd, m), "subtopics", m, topic, widest_spread="sd")
        shares = D.overall_label_shares(c)
        for v in ("negative", "neutral", "positive"):
            add(shares, "models", m, F.lit(v), overall_share=f"{m}_{v}_pct")
        corr = CT.post_comment_correlation(CT.post_comment_pairs(c, label, ROW_ORDER))
        add(corr, "post_comment", m, F.lit("all posts"), r="r", p_value="p_value")
    gl = materialize(TR.gain_loss_top(TR.topic_change(ty)))
    for side in ("gaining", "losing"):
        add(gl.where(F.col("side") == side), "prevalence", "all", topic, **{side: "change"})
    add(AG.topic_model_correlation(td, with_p=True), "models", "both", F.lit("all topics"), topic_r="r", topic_p_value="p_value")
    add(AG.max_disagreement(td, ["topic"]), "models", "both", topic, topic_disagreement="difference")
    add(AG.max_disagreement(sd, ["topic", "subtopic"]), "models", "both", cell, subtopic_disagreement="difference")
    top = [td.orderBy(F.desc(f"{m}_neg_pct"), "topic").limit(1).select("topic") for m in ("bert", "vader")]
    add(top[0].join(top[1], "topic").agg(F.count(F.lit(1)).alias("n")), "models", "both", F.lit("most negative"),
        same_top_topic="n")
    add(D.volume_regression(mv), "volume", "bert", F.lit("monthly volume"), slope="slope", r2="r2", r="r")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return finish(out)


@register("findings_json", with_comments("""
SELECT '{"label":"' || label || '","n":' || n || '}' AS json FROM (
  SELECT bert_label AS label, count(*) AS n FROM comments WHERE bert_label IS NOT NULL GROUP BY 1)"""))
def q_findings_json(spark, sf):
    """A4: a result written as JSON records and read back as lines."""
    n = comments(spark, sf).where("bert_label is not null").groupBy(F.col("bert_label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    path = IO.scratch_path(spark, "json")
    IO.write_json(n, path)
    out = materialize(spark.read.text(path).select(F.col("value").alias("json")))
    IO.drop_path(spark, path)
    return out


# ------------------------------------------------------------------ A1 / A3 / A4

@register("csv_roundtrip", """
SELECT CAST(r.conv_id AS VARCHAR) AS post_id, CAST(r.turn AS VARCHAR) AS comment_id, h.role AS post_title,
       h.text AS post_body, CASE WHEN r.turn > 0 THEN r.text ELSE '' END AS comment_body
FROM conversations r LEFT JOIN (SELECT conv_id, role, text FROM conversations WHERE turn = 0) h USING (conv_id)""")
def q_csv_roundtrip(spark, sf):
    """A1 + A3: conversations in the raw schema written as CSV (multi-line quoted
    bodies) to the shared scratch area and read back with an explicit schema."""
    raw = conv_raw(spark, sf).select(
        F.lit(None).cast("string").alias("subreddit"), F.col("post_id").cast("string").alias("post_id"),
        F.lit(None).cast("double").alias("post_created_utc"), "post_title", "post_body",
        F.lit(None).cast("long").alias("post_score"), F.lit(None).cast("string").alias("post_url"),
        F.col("comment_id").cast("string").alias("comment_id"), "comment_body",
        F.lit(None).cast("long").alias("comment_score"), F.lit(None).cast("double").alias("comment_created_utc"))
    path = IO.scratch_path(spark, "csv")
    IO.write_csv(raw, path)
    back = IO.read_csv(spark, path, IO.RAW_SCHEMA)
    out = materialize(back.select("post_id", "comment_id", "post_title", "post_body", "comment_body"))
    IO.drop_path(spark, path)
    return out


# ------------------------------------------------------------------ M1 / M2

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@register("stream_share_by_window", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS label, count(*) AS n,
       round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY date_trunc('day', ts)), 6) AS share
FROM events GROUP BY date_trunc('day', ts), event_type""")
def q_stream_share_by_window(spark, sf):
    """M1: daily tumbling-window label shares from a streaming file source."""
    res = LV.stream_window_shares(spark, f"{sf.rstrip('/')}/events.parquet", EVENT_SCHEMA, "ts", "event_type")
    return finish(res.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                             "label", "n", "share"))


@register("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def q_stream_first_seen(spark, sf):
    """M2: first sighting of every (user, event type) in the stream."""
    res = LV.stream_first_seen(spark, f"{sf.rstrip('/')}/events.parquet", EVENT_SCHEMA, "ts", ["user_id", "event_type"])
    return res.select("user_id", "event_type")


# ------------------------------------------------------------------ O1 / O2 / O3 (optional rows)

@register("engagement_by_topic", with_pc(f"""
SELECT topic, count(*) AS n_posts, round(avg(n_comments), 6) AS mean_comments,
       round(corr(n_comments, post_polarity), 6) AS r_volume_polarity FROM (
  SELECT post_id, count(*) AS n_comments, first(topic_id ORDER BY {SQL_ORDER}) AS topic,
         first(CASE WHEN bert_label = 'positive' THEN 1 WHEN bert_label = 'negative' THEN -1 ELSE 0 END
               ORDER BY {SQL_ORDER}) AS post_polarity
  FROM pc GROUP BY post_id) GROUP BY topic"""))
def q_engagement_by_topic(spark, sf):
    """O1: comment volume per post and its correlation with post polarity, by topic."""
    pc = posts_comments(spark, sf).withColumn("comment_score", F.col("l_quantity"))
    return finish(D.engagement_correlation(D.engagement_by_post(pc, ROW_ORDER)))


@register("sentiment_by_community", with_pc(f"""
SELECT coalesce(CAST(subreddit AS VARCHAR), 'None') AS topic, count(*) AS n_rows,
       {", ".join(f"round(CASE WHEN count({c}) > 0 THEN 1.0 * sum(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END) / count({c}) ELSE 0.0 END, 6) AS {p}_{s}_pct"
                  for p, c in (("vader", "vader_label"), ("bert", "bert_label")) for v, s in (("positive", "pos"), ("neutral", "neu"), ("negative", "neg")))}
FROM pc GROUP BY 1"""))
def q_sentiment_by_community(spark, sf):
    """O2: the F4 distribution keyed by source community."""
    return finish(D.topic_label_distribution(posts_comments(spark, sf), topic_col="subreddit",
                                             lexicon_label="vader_label", model_label="bert_label"))


@register("short_text_filter", "SELECT lang, count(*) AS n_docs FROM documents WHERE length(coalesce(text, '')) >= 200 GROUP BY 1")
def q_short_text_filter(spark, sf):
    """O3: documents of at least 200 characters, per language."""
    return D.min_length(docs(spark, sf), "text", 200).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
