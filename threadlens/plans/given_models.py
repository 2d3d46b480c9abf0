"""Registered queries that apply given models (E1, D4, N2) and keep physical row order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_LEXICON
from ..operators import inference as INF
from ..operators import sentiment as SE
from ..operators.common import materialize
from ..operators.words import counted_words
from ..sources import io as IO
from ..sources.tables import docs
from .registry import finish, register

# Words of a document, as both engines cut them.
_WORDS = "SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM documents"


def _counts(spark, sf):
    """``doc, lang, term, n``, a row for every term of every row of the table."""
    return counted_words(docs(spark, sf).select(F.col("doc_id").alias("doc"), "lang", "text"), "text")


# Topics: the languages' term shares, half a token added to every term in every one.
_SMOOTH = 0.5
_ALPHA, _TOLERANCE, _STEPS = 0.1, 1e-5, 100
_MIXTURES = f"""WITH RECURSIVE c AS (SELECT doc_id AS doc, lang, term, count(*) AS n FROM ({_WORDS}) GROUP BY ALL),
v AS (SELECT count(DISTINCT term) AS size FROM c),
t AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1),
g AS (SELECT term, lang, sum(n) AS n FROM c GROUP BY ALL),
phi AS (
  SELECT w.term, list((coalesce(g.n, 0) + {_SMOOTH}) / (t.total + {_SMOOTH} * v.size) ORDER BY t.lang) AS phi
  FROM (SELECT DISTINCT term FROM c) w CROSS JOIN t CROSS JOIN v LEFT JOIN g ON g.term = w.term AND g.lang = t.lang GROUP BY 1),
d AS (
  SELECT doc, list({{'n': CAST(n AS DOUBLE), 'phi': phi}} ORDER BY term) AS cells, sum(CAST(n AS DOUBLE)) AS total
  FROM (SELECT doc, term, sum(n) AS n FROM c GROUP BY ALL) JOIN phi USING (term) GROUP BY 1),
s AS (
  SELECT doc, 0 AS step, CAST(NULL AS DOUBLE) AS moved, [1.0::DOUBLE / len(cells[1].phi) FOR p IN cells[1].phi] AS theta FROM d
  UNION ALL
  SELECT doc, step + 1, list_max([abs(new[j] - theta[j]) FOR j IN range(1, len(theta) + 1)]), new
  FROM (SELECT s.doc, step, theta, [(list_sum([c.n * theta[j] * c.phi[j] / list_dot_product(theta, c.phi) FOR c IN cells])
                + {_ALPHA}) / (total + {_ALPHA} * len(theta)) FOR j IN range(1, len(theta) + 1)] AS new
        FROM s JOIN d ON d.doc = s.doc WHERE step < {_STEPS} AND (moved IS NULL OR moved >= {_TOLERANCE}))),
l AS (SELECT doc, max(step) AS step FROM s GROUP BY 1)
SELECT s.doc AS doc_id, round(theta[1], 6) AS share_1, round(theta[2], 6) AS share_2, round(theta[3], 6) AS share_3,
       round(theta[4], 6) AS share_4,
       round((list_sum([c.n * ln(list_dot_product(theta, c.phi)) FOR c IN cells])
              + {_ALPHA} * list_sum([ln(x) FOR x IN theta])) / total, 6) AS bound_per_token, s.moved < {_TOLERANCE} AS converged
FROM s JOIN l ON l.doc = s.doc AND l.step = s.step JOIN d ON d.doc = s.doc"""


@register("fixed_topic_mixtures", _MIXTURES)
def q_fixed_topic_mixtures(spark, sf):
    """Every document's mixture of four given topics, and its bound a token."""
    c = materialize(_counts(spark, sf))
    by = materialize(c.groupBy("term", "lang").agg(F.sum("n").alias("n")))
    totals = by.groupBy("lang").agg(F.sum("n").alias("total"))
    size = by.select("term").distinct().count()
    # Four languages: one array of (language, total) rows for every term.
    listed = totals.agg(F.sort_array(F.collect_list(F.struct("lang", "total"))).alias("t"))
    terms = by.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    phi = INF.attach_scalars(terms, listed).select("term", F.transform("t", lambda t: (
        F.coalesce(F.element_at("m", t["lang"]), F.lit(0)) + _SMOOTH) / (t["total"] + _SMOOTH * size)).alias("phi"))
    # A document that stands there twice has its cells twice over, which gives the same mixture as their sum.
    # Every term has a share, so no word is missing from ``total``.
    got = INF.infer_mixtures(c.where("doc is not null"), phi, _ALPHA, _TOLERANCE, _STEPS)
    return finish(got.select(
        F.col("doc").alias("doc_id"), *[F.get("theta", F.lit(i)).alias(f"share_{i + 1}") for i in range(4)],
        (F.col("bound") / F.col("total")).alias("bound_per_token"), "converged"))


# A stored linear model of three labels: the lexicon's valences and a few frequent words.
_WEIGHTS = [(t, lab, w) for t, v in DEFAULT_LEXICON for lab, w in (("positive", v / 2), ("negative", -v / 2))] + [
    ("the", "neutral", 0.02), ("de", "neutral", 0.03), ("der", "positive", 0.04), ("que", "negative", 0.05),
    ("and", "positive", 0.01), ("in", "negative", 0.02)]
_BIAS = [("negative", -0.1), ("neutral", 0.2), ("positive", 0.05)]
_VALUES = ", ".join(f"('{t}', '{lab}', CAST({w} AS DOUBLE))" for t, lab, w in _WEIGHTS)
_BIASES = ", ".join(f"('{lab}', CAST({b} AS DOUBLE))" for lab, b in _BIAS)


@register("model_sentiment_fixed", f"""WITH w(term, label, weight) AS (VALUES {_VALUES}), b(label, bias) AS (VALUES {_BIASES}),
c AS (SELECT doc_id, term, count(*) AS n FROM ({_WORDS}) GROUP BY ALL),
x AS (SELECT c.doc_id, w.label, sum(c.n * w.weight) AS dot FROM c JOIN w ON w.term = c.term GROUP BY ALL),
z AS (SELECT d.doc_id, b.label, b.bias + coalesce(x.dot, 0) AS z
      FROM documents d CROSS JOIN b LEFT JOIN x ON x.doc_id = d.doc_id AND x.label = b.label),
p AS (SELECT doc_id, label, exp(z - max(z) OVER (PARTITION BY doc_id)) / sum(exp(z)) OVER (PARTITION BY doc_id)
             * exp(max(z) OVER (PARTITION BY doc_id)) AS p,
             row_number() OVER (PARTITION BY doc_id ORDER BY z DESC, label) AS r FROM z)
SELECT doc_id, label AS bert_label, round(p, 6) AS bert_score FROM p WHERE r = 1""")
def q_model_sentiment_fixed(spark, sf):
    """A stored linear model applied to every document, without a fit."""
    counts = _counts(spark, sf).select("doc", "term", "n")
    w = spark.createDataFrame(_WEIGHTS, "term string, label string, weight double")
    b = spark.createDataFrame(_BIAS, "label string, bias double")
    got = INF.score_with_weights(docs(spark, sf).select(F.col("doc_id").alias("doc")), counts, w, b)
    return finish(got.withColumnRenamed("doc", "doc_id"))


def _load_length_scorer():
    """A stand-in for a loaded model: label and score follow from the text's length."""
    return lambda texts: [(f"LABEL_{len(t) % 3}", 1.0 / (1 + len(t) % 7)) for t in texts]


@register("batch_scorer", r"""SELECT doc_id, CASE n % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS bert_label,
       round(1.0::DOUBLE / (1 + n % 7), 6) AS bert_score
FROM (SELECT doc_id, length(CASE WHEN regexp_full_match(coalesce(text, ''), '\s*') THEN 'neutral' ELSE text END) AS n FROM documents)""")
def q_batch_scorer(spark, sf):
    """Any batch scorer over Arrow batches, loaded once a task, labels normalised."""
    d = docs(spark, sf).select("doc_id", "text")
    return finish(SE.score_with_udf_model(d, "text", _load_length_scorer).drop("text"))


@register("prefix_scan_file_order", "SELECT lang, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id "
                                    "FROM (SELECT * FROM documents LIMIT 333) GROUP BY 1")
def q_prefix_scan_file_order(spark, sf):
    """A2: the first rows as they stand in the file, then counts over them."""
    pre = IO.prefix_in_file_order(spark, f"{sf}/documents.parquet", 333)
    return pre.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"),
                                   F.max("doc_id").alias("last_id"))


@register("positional_concat", "SELECT doc_id, lang, length(coalesce(text, '')) AS n_points, strlen(coalesce(text, '')) AS n_bytes, "
                               "row_number() OVER () - 1 AS position FROM documents")
def q_positional_concat(spark, sf):
    """Two outputs made apart from the same source, put beside its columns by row position."""
    src = IO.with_position(spark, f"{sf}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    points = materialize(src.select("position", F.length(text).cast("long").alias("n_points")))
    sizes = materialize(src.select("position", F.octet_length(text).cast("long").alias("n_bytes")))
    return IO.positional_concat(src.select("position", "doc_id", "lang"), points, sizes)
