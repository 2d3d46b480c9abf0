"""Registered aggregate queries over the posts x comments binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import LABELS, normalize_model_label, polarity
from ..functions.stats import pearson_p_sql
from ..operators import agreement as AG
from ..operators import contagion as CT
from ..operators import distributions as D
from ..operators import risk as RK
from ..operators import trends as TR
from ..operators.common import broadcast_if_small
from ..sources.tables import ROW_ORDER, comments, posts, posts_comments
from .registry import finish, register
from .sqlbind import ROW_ORDER as SQL_ORDER
from .sqlbind import with_comments, with_pc

SHORT = {"positive": "pos", "neutral": "neu", "negative": "neg"}


def _share(label: str, v: str, all_rows: bool) -> str:
    den = "count(*)" if all_rows else f"count({label})"
    return (f"round(CASE WHEN {den} > 0 THEN 1.0 * sum(CASE WHEN {label} = '{v}' THEN 1 ELSE 0 END) / {den} "
            f"ELSE 0.0 END, 6)")


def _model_shares(all_rows: bool, models=(("vader", "vader_label"), ("bert", "bert_label"))) -> str:
    return ", ".join(f"{_share(col, v, all_rows)} AS {p}_{SHORT[v]}_pct"
                     for p, col in models for v in ("positive", "neutral", "negative"))


# ------------------------------------------------------------------ F7 / F8

def _year_share_sql(label):
    return with_comments(f"""
SELECT CAST(year(comment_created_utc) AS INTEGER) AS year,
       {", ".join(f"round(1.0 * sum(CASE WHEN {label} = '{v}' THEN 1 ELSE 0 END) / count(*), 6) AS {v}" for v in LABELS)}
FROM comments WHERE comment_created_utc IS NOT NULL AND {label} IS NOT NULL
GROUP BY 1""")


@register("label_share_by_year_b", _year_share_sql("bert_label"))
def q_label_share_by_year_b(spark, sf):
    return finish(D.label_share_by_period(comments(spark, sf), "bert_label", "year"))


@register("label_share_by_year_a", _year_share_sql("vader_label"))
def q_label_share_by_year_a(spark, sf):
    return finish(D.label_share_by_period(comments(spark, sf), "vader_label", "year"))


@register("label_share_by_month", with_comments(f"""
SELECT strftime(date_trunc('month', comment_created_utc), '%Y-%m-%d') AS month,
       {", ".join(f"round(1.0 * sum(CASE WHEN bert_label = '{v}' THEN 1 ELSE 0 END) / count(*), 6) AS {v}" for v in LABELS)}
FROM comments WHERE comment_created_utc IS NOT NULL AND bert_label IS NOT NULL
GROUP BY 1"""))
def q_label_share_by_month(spark, sf):
    return finish(D.label_share_by_period(comments(spark, sf), "bert_label", "month"))


# ------------------------------------------------------------------ F9 / F10 / F11 / I3

_TOPIC_YEAR = """ty AS (
  SELECT year, topic, n, 1.0 * n / sum(n) OVER (PARTITION BY year) AS share FROM (
    SELECT CAST(year(comment_created_utc) AS INTEGER) AS year, topic_id AS topic, count(*) AS n
    FROM pc WHERE comment_created_utc IS NOT NULL AND topic_id IS NOT NULL GROUP BY 1, 2))"""


@register("topic_share_by_month", with_pc("""
SELECT month, topic, n, round(1.0 * n / sum(n) OVER (PARTITION BY month), 6) AS share FROM (
  SELECT strftime(date_trunc('month', comment_created_utc), '%Y-%m-%d') AS month, topic_id AS topic, count(*) AS n
  FROM pc WHERE comment_created_utc IS NOT NULL AND topic_id IS NOT NULL GROUP BY 1, 2)"""))
def q_topic_share_by_month(spark, sf):
    return finish(D.topic_share_by_period(posts_comments(spark, sf), "month", "comment_created_utc", "topic_id"))


@register("topic_share_by_year", with_pc("SELECT year, topic, n, round(share, 6) AS share FROM ty", _TOPIC_YEAR))
def q_topic_share_by_year(spark, sf):
    return finish(D.topic_share_by_period(posts_comments(spark, sf), "year", "comment_created_utc", "topic_id"))


_TOPIC_CHANGE = """tc AS (
  SELECT topic, min(fy) AS first_year, min(ly) AS last_year,
         coalesce(sum(CASE WHEN year = fy THEN share END), 0.0) AS first_share,
         coalesce(sum(CASE WHEN year = ly THEN share END), 0.0) AS last_share
  FROM ty, (SELECT min(year) AS fy, max(year) AS ly FROM ty) b
  GROUP BY topic HAVING min(ly) > min(fy))"""


@register("topic_change_first_last", with_pc("""
SELECT topic, first_year, last_year, round(first_share, 6) AS first_share, round(last_share, 6) AS last_share,
       round(last_share - first_share, 6) AS change FROM tc""", _TOPIC_YEAR, _TOPIC_CHANGE))
def q_topic_change(spark, sf):
    ty = D.topic_share_by_period(posts_comments(spark, sf), "year", "comment_created_utc", "topic_id")
    return finish(TR.topic_change(ty))


@register("topic_gain_loss_top3", with_pc("""
SELECT * FROM (SELECT 'gaining' AS side, topic, round(last_share - first_share, 6) AS change FROM tc
               ORDER BY last_share - first_share DESC, topic ASC LIMIT 3)
UNION ALL
SELECT * FROM (SELECT 'losing' AS side, topic, round(last_share - first_share, 6) AS change FROM tc
               ORDER BY last_share - first_share ASC, topic DESC LIMIT 3)""", _TOPIC_YEAR, _TOPIC_CHANGE))
def q_topic_gain_loss(spark, sf):
    ty = D.topic_share_by_period(posts_comments(spark, sf), "year", "comment_created_utc", "topic_id")
    return finish(TR.gain_loss_top(TR.topic_change(ty)))


# ------------------------------------------------------------------ F29

def _trend_sql(label):
    shares = ", ".join(f"1.0 * sum(CASE WHEN {label} = '{v}' THEN 1 ELSE 0 END) / count(*) AS {v}" for v in LABELS)
    unions = " UNION ALL ".join(f"SELECT CAST(year AS DOUBLE) AS x, '{v}' AS label, {v} AS share FROM ys" for v in LABELS)
    return with_comments(f"""
SELECT label, round(regr_slope(share, x), 6) AS slope,
       round(CASE WHEN var_samp(share) = 0 THEN 0.0 ELSE corr(x, share) * corr(x, share) END, 6) AS r_squared,
       CASE WHEN regr_slope(share, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
       round(arg_min(share, x), 6) AS start, round(arg_max(share, x), 6) AS "end",
       round(arg_max(share, x) - arg_min(share, x), 6) AS change, count(*) AS n_years
FROM ({unions}) GROUP BY label HAVING count(*) > 1""", f"""ys AS (
  SELECT CAST(year(comment_created_utc) AS INTEGER) AS year, {shares}
  FROM comments WHERE comment_created_utc IS NOT NULL AND {label} IS NOT NULL GROUP BY 1)""")


def _trend(spark, sf, label):
    return TR.label_trends(D.label_share_by_period(comments(spark, sf), label, "year"))


@register("label_trend_b", _trend_sql("bert_label"))
def q_label_trend_b(spark, sf):
    return finish(_trend(spark, sf, "bert_label").drop("p_value"))


@register("label_trend_a", _trend_sql("vader_label"))
def q_label_trend_a(spark, sf):
    return finish(_trend(spark, sf, "vader_label").drop("p_value"))


def _trend_p_sql(label):
    shares = ", ".join(f"1.0 * sum(CASE WHEN {label} = '{v}' THEN 1 ELSE 0 END) / count(*) AS {v}" for v in LABELS)
    unions = " UNION ALL ".join(f"SELECT CAST(year AS DOUBLE) AS x, '{v}' AS label, {v} AS share FROM ys" for v in LABELS)
    return with_comments(f"""
SELECT label, round(slope, 6) AS slope, round(r * r, 6) AS r_squared, round({pearson_p_sql("r", "n_years")}, 6) AS p_value,
       CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
       round(st, 6) AS start, round(en, 6) AS "end", round(en - st, 6) AS change, n_years
FROM (SELECT label, regr_slope(share, x) AS slope, CASE WHEN var_samp(share) = 0 THEN 0.0 ELSE corr(x, share) END AS r,
             arg_min(share, x) AS st, arg_max(share, x) AS en, count(*) AS n_years
      FROM ({unions}) GROUP BY label HAVING count(*) > 1)""", f"""ys AS (
  SELECT CAST(year(comment_created_utc) AS INTEGER) AS year, {shares}
  FROM comments WHERE comment_created_utc IS NOT NULL AND {label} IS NOT NULL GROUP BY 1)""")


@register("label_trend_significance", _trend_p_sql("bert_label"))
def q_label_trend_significance(spark, sf):
    """F29 with its p-value."""
    return finish(_trend(spark, sf, "bert_label"))


# ------------------------------------------------------------------ F1 / F6 / F38

@register("overall_label_shares", with_comments(f"""
SELECT {", ".join(f"round(avg(CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END), 6) AS {p}_{v}_pct"
                  for p, c in (("vader", "vader_label"), ("bert", "bert_label")) for v in ("positive", "neutral", "negative"))},
       count(*) AS n_rows FROM comments"""))
def q_overall_label_shares(spark, sf):
    return finish(D.overall_label_shares(comments(spark, sf)))


@register("label_counts_with_null", with_comments("SELECT bert_label AS label, count(*) AS n FROM comments GROUP BY 1"))
def q_label_counts_with_null(spark, sf):
    return finish(D.label_counts(comments(spark, sf), "bert_label"))


@register("label_counts_ordered", with_comments("""
SELECT o.label, o.label_order, coalesce(c.n, 0) AS n
FROM (VALUES ('negative', 0), ('neutral', 1), ('positive', 2)) o(label, label_order)
LEFT JOIN (SELECT vader_label AS label, count(*) AS n FROM comments GROUP BY 1) c USING (label)"""))
def q_label_counts_ordered(spark, sf):
    return finish(D.label_counts_ordered(comments(spark, sf), "vader_label"))


# ------------------------------------------------------------------ F2 / F3

@register("post_summary_by_topic", with_pc(f"""
SELECT topic_id, count(DISTINCT post_id) AS total_posts, {_model_shares(True)},
       round(avg(vader_compound), 6) AS vader_compound_avg, round(avg(bert_score), 6) AS bert_score_avg
FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY {SQL_ORDER}) AS rn FROM pc) f
WHERE rn = 1 AND topic_id IS NOT NULL GROUP BY topic_id"""))
def q_post_summary_by_topic(spark, sf):
    return finish(D.post_summary_by_topic(posts_comments(spark, sf), ROW_ORDER, topic_col="topic_id"))


@register("comment_summary_by_subtopic", with_pc(f"""
SELECT topic_id, comment_subtopic, count(comment_id) AS n_comments, {_model_shares(True)},
       round(avg(vader_compound), 6) AS vader_compound_avg, round(avg(bert_score), 6) AS bert_score_avg
FROM pc WHERE topic_id IS NOT NULL AND comment_subtopic IS NOT NULL GROUP BY 1, 2"""))
def q_comment_summary_by_subtopic(spark, sf):
    return finish(D.comment_summary_by_subtopic(posts_comments(spark, sf), topic_col="topic_id"))


# ------------------------------------------------------------------ F4 / F5 / F12 / F13 / F42

_TOPIC_DIST = f"""td AS (
  SELECT coalesce(CAST(topic_id AS VARCHAR), 'None') AS topic, count(*) AS n_rows, {_model_shares(False)}
  FROM pc GROUP BY 1)"""
_SUB_DIST = f"""sd AS (
  SELECT topic_id AS topic, comment_subtopic AS subtopic, count(*) AS n_rows, {_model_shares(False)}
  FROM pc WHERE topic_id IS NOT NULL AND comment_subtopic IS NOT NULL GROUP BY 1, 2)"""


def topic_dist(spark, sf):
    return D.topic_label_distribution(posts_comments(spark, sf), topic_col="topic_id")


def sub_dist(spark, sf):
    return D.subtopic_label_distribution(posts_comments(spark, sf), topic_col="topic_id",
                                         subtopic_col="comment_subtopic")


@register("topic_label_distribution", with_pc("SELECT * FROM td", _TOPIC_DIST))
def q_topic_label_distribution(spark, sf):
    return finish(topic_dist(spark, sf))


@register("subtopic_label_distribution", with_pc("SELECT * FROM sd", _SUB_DIST))
def q_subtopic_label_distribution(spark, sf):
    return finish(sub_dist(spark, sf))


def _matrix_sql(key, label, src):
    return f"""
SELECT {key}, {", ".join(f"round(1.0 * sum(CASE WHEN {label} = '{v}' THEN 1 ELSE 0 END) / count({label}), 6) AS {v}" for v in LABELS)}
FROM {src} WHERE {key} IS NOT NULL AND {label} IS NOT NULL GROUP BY 1"""


@register("topic_label_matrix", with_pc(_matrix_sql("topic_id", "bert_label", "pc")))
def q_topic_label_matrix(spark, sf):
    return finish(D.label_matrix(posts_comments(spark, sf), "topic_id", "bert_label"))


@register("subtopic_label_matrix_pooled", with_comments(_matrix_sql("comment_subtopic", "vader_label", "comments")))
def q_subtopic_label_matrix_pooled(spark, sf):
    return finish(D.label_matrix(comments(spark, sf), "comment_subtopic", "vader_label"))


@register("stacked_offsets", with_pc("""
SELECT topic, label, round(share, 6) AS share,
       round(coalesce(sum(share) OVER (PARTITION BY topic ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS base
FROM (SELECT topic, 0 AS rk, 'positive' AS label, bert_pos_pct AS share FROM td
      UNION ALL SELECT topic, 1, 'neutral', bert_neu_pct FROM td
      UNION ALL SELECT topic, 2, 'negative', bert_neg_pct FROM td)""", _TOPIC_DIST.replace("round(", "(").replace(", 6)", ")")))
def q_stacked_offsets(spark, sf):
    return finish(D.stacked_offsets(topic_dist(spark, sf), ["topic"], "bert"))


# ------------------------------------------------------------------ F14-F18

@register("model_confusion_share", with_comments("""
SELECT label_a, label_b, round(1.0 * n / sum(n) OVER (), 6) AS share FROM (
  SELECT bert_label AS label_a, vader_label AS label_b, count(*) AS n FROM comments
  WHERE bert_label IS NOT NULL AND vader_label IS NOT NULL GROUP BY 1, 2)"""))
def q_model_confusion_share(spark, sf):
    return finish(AG.confusion_share(comments(spark, sf), "bert_label", "vader_label"))


@register("model_confusion_counts", with_comments(f"""
SELECT g.label_a, g.row_order, {", ".join(f"CAST(coalesce(c.n_{v}, 0) AS BIGINT) AS n_{v}" for v in LABELS)}
FROM (VALUES ('negative', 0), ('neutral', 1), ('positive', 2)) g(label_a, row_order)
LEFT JOIN (SELECT vader_label AS label_a, {", ".join(f"sum(CASE WHEN bert_label = '{v}' THEN 1 ELSE 0 END) AS n_{v}" for v in LABELS)}
           FROM comments WHERE vader_label IN ('negative', 'neutral', 'positive')
             AND bert_label IN ('negative', 'neutral', 'positive') GROUP BY 1) c USING (label_a)"""))
def q_model_confusion_counts(spark, sf):
    return finish(AG.confusion_counts(comments(spark, sf), "vader_label", "bert_label"))


@register("model_agreement", with_comments("""
SELECT round(avg(CASE WHEN vader_label = bert_label THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n
FROM comments WHERE vader_label IS NOT NULL AND bert_label IS NOT NULL"""))
def q_model_agreement(spark, sf):
    return finish(AG.agreement_rate(comments(spark, sf), "vader_label", "bert_label"))


_CLASS_TABLE = """pcn AS (
  SELECT vader_label AS a, bert_label AS b, count(*) AS n FROM comments
  WHERE vader_label IS NOT NULL AND bert_label IS NOT NULL GROUP BY 1, 2),
ct AS (
  SELECT cls, coalesce(s.support, 0) AS support, coalesce(p.predicted, 0) AS predicted, coalesce(t.tp, 0) AS tp
  FROM (SELECT a AS cls, sum(n) AS support FROM pcn GROUP BY 1) s
  FULL OUTER JOIN (SELECT b AS cls, sum(n) AS predicted FROM pcn GROUP BY 1) p USING (cls)
  LEFT JOIN (SELECT a AS cls, n AS tp FROM pcn WHERE a = b) t USING (cls)),
per AS (
  SELECT cls AS class, CASE WHEN predicted > 0 THEN 1.0 * tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN 1.0 * tp / support ELSE 0.0 END AS recall, support, tp FROM ct),
per2 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per)"""


@register("class_report", with_comments("""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round(1.0 * sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per2""", _CLASS_TABLE))
def q_class_report(spark, sf):
    return finish(AG.class_report(comments(spark, sf), "vader_label", "bert_label"))


@register("cohen_kappa", with_comments("""
SELECT round(po, 6) AS observed, round(pe, 6) AS expected,
       round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END, 6) AS kappa FROM (
  SELECT 1.0 * sum(tp) / sum(support) AS po, 1.0 * sum(support * predicted) / (1.0 * sum(support) * sum(support)) AS pe
  FROM ct)""", _CLASS_TABLE))
def q_cohen_kappa(spark, sf):
    return finish(AG.cohen_kappa(comments(spark, sf), "vader_label", "bert_label"))


# ------------------------------------------------------------------ F32 / F33

_TD_RAW = _TOPIC_DIST.replace("round(", "(").replace(", 6)", ")")
_SD_RAW = _SUB_DIST.replace("round(", "(").replace(", 6)", ")")


@register("topic_model_correlation", with_pc("""
SELECT round(corr(bert_neg_pct, vader_neg_pct), 6) AS r, count(*) AS n_topics,
       CASE WHEN abs(corr(bert_neg_pct, vader_neg_pct)) > 0.7 THEN 'strong'
            WHEN abs(corr(bert_neg_pct, vader_neg_pct)) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength
FROM td""", _TD_RAW))
def q_topic_model_correlation(spark, sf):
    return finish(AG.topic_model_correlation(topic_dist(spark, sf)))


@register("topic_model_significance", with_pc(f"""
SELECT round(r, 6) AS r, n_topics, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate'
       ELSE 'weak' END AS strength, round({pearson_p_sql("r", "n_topics")}, 6) AS p_value
FROM (SELECT corr(bert_neg_pct, vader_neg_pct) AS r, count(*) AS n_topics FROM td)""", _TD_RAW))
def q_topic_model_significance(spark, sf):
    """F32 + F25: cross-model r over topics with its p."""
    return finish(AG.topic_model_correlation(topic_dist(spark, sf), with_p=True))


@register("topic_max_disagreement", with_pc("""
SELECT topic, round(bert_neg_pct, 6) AS bert_neg_pct, round(vader_neg_pct, 6) AS vader_neg_pct,
       round(abs(bert_neg_pct - vader_neg_pct), 6) AS difference
FROM td ORDER BY abs(bert_neg_pct - vader_neg_pct) DESC, topic LIMIT 1""", _TD_RAW))
def q_topic_max_disagreement(spark, sf):
    return finish(AG.max_disagreement(topic_dist(spark, sf), ["topic"]))


@register("subtopic_max_disagreement", with_pc("""
SELECT topic, subtopic, round(bert_neg_pct, 6) AS bert_neg_pct, round(vader_neg_pct, 6) AS vader_neg_pct,
       round(abs(bert_neg_pct - vader_neg_pct), 6) AS difference
FROM sd ORDER BY abs(bert_neg_pct - vader_neg_pct) DESC, topic, subtopic LIMIT 1""", _SD_RAW))
def q_subtopic_max_disagreement(spark, sf):
    return finish(AG.max_disagreement(sub_dist(spark, sf), ["topic", "subtopic"]))


# ------------------------------------------------------------------ F19 / F20

_MONTHLY = """mv AS (
  SELECT strftime(date_trunc('month', comment_created_utc), '%Y-%m-%d') AS month, count(bert_label) AS volume,
         avg(CASE WHEN bert_label = 'negative' THEN 1.0 ELSE 0.0 END) AS neg_share
  FROM comments WHERE comment_created_utc IS NOT NULL GROUP BY 1)"""


@register("volume_vs_negative", with_comments("SELECT month, volume, round(neg_share, 6) AS neg_share FROM mv", _MONTHLY))
def q_volume_vs_negative(spark, sf):
    return finish(D.monthly_volume_negative(comments(spark, sf), "bert_label"))


@register("volume_regression", with_comments("""
SELECT round(regr_slope(neg_share, volume), 6) AS slope, round(regr_intercept(neg_share, volume), 6) AS intercept,
       round(regr_r2(neg_share, volume), 6) AS r2, round(corr(volume, neg_share), 6) AS r, count(*) AS n_months
FROM mv""", _MONTHLY))
def q_volume_regression(spark, sf):
    return finish(D.volume_regression(D.monthly_volume_negative(comments(spark, sf), "bert_label")))


# ------------------------------------------------------------------ F21-F28, F35

_PAIRS = f"""pp AS (
  SELECT post_id, post_label, avg_comment_score, n_comments,
         CASE WHEN post_label = 'positive' THEN 1 WHEN post_label = 'negative' THEN -1 ELSE 0 END AS post_score
  FROM (
    SELECT post_id,
           first(bert_label ORDER BY {SQL_ORDER}) FILTER (WHERE bert_label IS NOT NULL) AS post_label,
           avg(CASE WHEN bert_label = 'positive' THEN 1.0 WHEN bert_label = 'negative' THEN -1.0 ELSE 0.0 END) AS avg_comment_score,
           count(comment_id) AS n_comments
    FROM comments GROUP BY post_id))"""


@register("post_comment_pairs", with_comments(
    "SELECT post_id, post_label, round(avg_comment_score, 6) AS avg_comment_score, n_comments, post_score FROM pp",
    _PAIRS))
def q_post_comment_pairs(spark, sf):
    return finish(CT.post_comment_pairs(comments(spark, sf), "bert_label", ROW_ORDER))


@register("post_comment_corr", with_comments("""
SELECT n_posts, round(r, 6) AS r, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength,
       CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction
FROM (SELECT count(*) AS n_posts, CASE WHEN count(*) > 10 THEN corr(post_score, avg_comment_score) END AS r,
             regr_slope(avg_comment_score, post_score) AS slope, regr_intercept(avg_comment_score, post_score) AS intercept
      FROM pp)""", _PAIRS))
def q_post_comment_corr(spark, sf):
    return finish(CT.post_comment_correlation(CT.post_comment_pairs(comments(spark, sf), "bert_label", ROW_ORDER))
                  .drop("p_value"))


_STRENGTH = ("CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength, "
             "CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction")


@register("post_comment_significance", with_comments(f"""
SELECT n_posts, round(r, 6) AS r, round({pearson_p_sql("r", "n_posts")}, 6) AS p_value, round(slope, 6) AS slope,
       round(intercept, 6) AS intercept, {_STRENGTH}
FROM (SELECT count(*) AS n_posts, CASE WHEN count(*) > 10 THEN corr(post_score, avg_comment_score) END AS r,
             regr_slope(avg_comment_score, post_score) AS slope,
             regr_intercept(avg_comment_score, post_score) AS intercept FROM pp)""",
                                                        _PAIRS.replace("bert_label", "vader_label")))
def q_post_comment_significance(spark, sf):
    """F24 + F25: r with its two-sided p (model A)."""
    return finish(CT.post_comment_correlation(CT.post_comment_pairs(comments(spark, sf), "vader_label", ROW_ORDER)))


def _bin_sql(x):
    return (f"CASE WHEN {x} > -2.0 AND {x} <= -0.5 THEN 'Negative' WHEN {x} > -0.5 AND {x} <= 0.5 THEN 'Neutral' "
            f"WHEN {x} > 0.5 AND {x} <= 2.0 THEN 'Positive' END")


@register("post_comment_alignment", with_comments(f"""
SELECT post_cat, comment_cat, n, round(1.0 * n / sum(n) OVER (PARTITION BY post_cat), 6) AS share FROM (
  SELECT {_bin_sql('post_score')} AS post_cat, {_bin_sql('avg_comment_score')} AS comment_cat, count(*) AS n
  FROM pp GROUP BY 1, 2) WHERE post_cat IS NOT NULL AND comment_cat IS NOT NULL""", _PAIRS))
def q_post_comment_alignment(spark, sf):
    return finish(CT.alignment_matrix(CT.post_comment_pairs(comments(spark, sf), "bert_label", ROW_ORDER)))


@register("post_label_maps", with_comments(f"""
SELECT p.post_id, p.n_comments, p.post_label, m.label_counts FROM (
  SELECT post_id, count(comment_id) AS n_comments, first(vader_label ORDER BY {SQL_ORDER}) FILTER (WHERE vader_label IS NOT NULL) AS post_label
  FROM comments GROUP BY post_id) p
LEFT JOIN (SELECT post_id, string_agg(vader_label || ':' || n, ';' ORDER BY vader_label) AS label_counts
           FROM (SELECT post_id, vader_label, count(*) AS n FROM comments WHERE vader_label IS NOT NULL GROUP BY 1, 2)
           GROUP BY post_id) m USING (post_id)"""))
def q_post_label_maps(spark, sf):
    m = CT.post_label_maps(comments(spark, sf), "vader_label", ROW_ORDER)
    return finish(m.withColumn("label_counts", F.array_join(F.transform(
        F.map_entries("label_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")))


# ------------------------------------------------------------------ I1 / I2 / G4 / F30 / F31 / F34

@register("top_negative_topics", with_pc("""
SELECT 'bert' AS model, topic, round(bert_neg_pct, 6) AS neg_pct, n_rows FROM td
ORDER BY bert_neg_pct DESC, topic LIMIT 5""", _TD_RAW))
def q_top_negative_topics(spark, sf):
    return finish(RK.top_negative_topics(topic_dist(spark, sf), "bert", 5))


@register("top_negative_subtopics", with_pc("""
SELECT 'vader' AS model, topic, subtopic, printf('T%d-S%d', topic, subtopic) AS label,
       round(vader_neg_pct, 6) AS neg_pct, n_rows FROM sd
ORDER BY vader_neg_pct DESC, topic, subtopic LIMIT 10""", _SD_RAW))
def q_top_negative_subtopics(spark, sf):
    return finish(RK.top_negative_subtopics(sub_dist(spark, sf), "vader", 10))


@register("risk_model_compare", with_pc("""
SELECT topic, round(coalesce(b.bert, 0.0), 6) AS bert, round(coalesce(v.vader, 0.0), 6) AS vader
FROM (SELECT topic, bert_neg_pct AS bert FROM td ORDER BY bert_neg_pct DESC, topic LIMIT 5) b
FULL OUTER JOIN (SELECT topic, vader_neg_pct AS vader FROM td ORDER BY vader_neg_pct DESC, topic LIMIT 5) v USING (topic)""",
    _TD_RAW))
def q_risk_model_compare(spark, sf):
    return finish(RK.risk_model_compare(topic_dist(spark, sf), 5))


@register("topic_extremes", with_pc(" UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{m}' AS model, '{k}' AS kind, topic, round({m}_{c}_pct, 6) AS pct, n_rows FROM td
        ORDER BY {m}_{c}_pct DESC, topic LIMIT 1)"""
    for m in ("bert", "vader") for k, c in (("most_negative", "neg"), ("most_positive", "pos"))), _TD_RAW))
def q_topic_extremes(spark, sf):
    return finish(RK.topic_extremes(topic_dist(spark, sf)))


@register("topic_neg_mean_sd", with_pc("""
SELECT round(avg(bert_neg_pct), 6) AS bert_mean, round(stddev_samp(bert_neg_pct), 6) AS bert_sd,
       round(avg(vader_neg_pct), 6) AS vader_mean, round(stddev_samp(vader_neg_pct), 6) AS vader_sd,
       count(*) AS n_topics FROM td""", _TD_RAW))
def q_topic_neg_mean_sd(spark, sf):
    return finish(RK.topic_neg_mean_sd(topic_dist(spark, sf)))


@register("subtopic_spread_max", with_pc("""
SELECT topic, round(sd, 6) AS sd, n_subtopics FROM (
  SELECT topic, stddev_samp(bert_neg_pct) AS sd, count(*) AS n_subtopics FROM sd GROUP BY topic)
WHERE sd IS NOT NULL AND NOT isnan(sd) ORDER BY sd DESC, topic LIMIT 1""", _SD_RAW))
def q_subtopic_spread_max(spark, sf):
    return finish(RK.subtopic_spread_max(sub_dist(spark, sf), "bert"))


# ------------------------------------------------------------------ E10 / F39 / F40 / D5 / D7

def _topic_names(spark, sf):
    names = posts(spark, sf).select("topic_id", F.col("topic_name").alias("topic_label")).distinct()
    return broadcast_if_small(names)


@register("label_pct_by_topic_name", with_pc(f"""
SELECT topic_label, {", ".join(f"round(100.0 * sum(CASE WHEN bert_label = '{v}' THEN 1 ELSE 0 END) / count(bert_label), 6) AS {v}" for v in LABELS)}
FROM (SELECT * EXCLUDE (topic_name) FROM pc) LEFT JOIN (SELECT DISTINCT topic_id, topic_name AS topic_label FROM posts) USING (topic_id)
WHERE bert_label IS NOT NULL GROUP BY topic_label"""))
def q_label_pct_by_topic_name(spark, sf):
    pc = posts_comments(spark, sf).drop("topic_name")
    return finish(D.label_pct_by_topic_name(pc, _topic_names(spark, sf), "bert_label"))


@register("mean_compound_by_topic_name", with_pc("""
SELECT topic_label, round(avg(vader_compound), 6) AS mean_compound
FROM (SELECT * EXCLUDE (topic_name) FROM pc) LEFT JOIN (SELECT DISTINCT topic_id, topic_name AS topic_label FROM posts) USING (topic_id)
GROUP BY topic_label"""))
def q_mean_compound_by_topic_name(spark, sf):
    pc = posts_comments(spark, sf).drop("topic_name")
    return finish(D.mean_compound_by_topic_name(pc, _topic_names(spark, sf)))


_RAW_LABEL_SQL = ("CASE WHEN l_returnflag = 'R' THEN 'NEGATIVE' WHEN l_returnflag = 'N' THEN 'LABEL_1' "
                  "WHEN l_linestatus = 'O' THEN 'Positive' ELSE 'label_2' END")


@register("normalize_model_labels", f"""
SELECT raw_label, CASE WHEN lower(raw_label) LIKE '%neg%' THEN 'negative' WHEN lower(raw_label) LIKE '%pos%' THEN 'positive'
  WHEN lower(raw_label) LIKE '%neu%' THEN 'neutral' WHEN lower(raw_label) LIKE '%label_0%' THEN 'negative'
  WHEN lower(raw_label) LIKE '%label_1%' THEN 'neutral' WHEN lower(raw_label) LIKE '%label_2%' THEN 'positive'
  ELSE lower(raw_label) END AS label, count(*) AS n
FROM (SELECT {_RAW_LABEL_SQL} AS raw_label FROM lineitem) GROUP BY 1, 2""")
def q_normalize_model_labels(spark, sf):
    from ..sources.tables import read_table
    li = read_table(spark, sf, "lineitem")
    raw = (F.when(F.col("l_returnflag") == "R", "NEGATIVE").when(F.col("l_returnflag") == "N", "LABEL_1")
           .when(F.col("l_linestatus") == "O", "Positive").otherwise("label_2"))
    return (li.select(raw.alias("raw_label"))
            .groupBy("raw_label", normalize_model_label("raw_label").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("label_polarity", with_comments("""
SELECT bert_label AS label, CASE WHEN bert_label = 'positive' THEN 1 WHEN bert_label = 'negative' THEN -1 ELSE 0 END AS polarity,
       count(*) AS n FROM comments GROUP BY 1, 2"""))
def q_label_polarity(spark, sf):
    c = comments(spark, sf)
    return c.groupBy(F.col("bert_label").alias("label"), polarity("bert_label").alias("polarity")) \
            .agg(F.count(F.lit(1)).alias("n"))
