"""Registered model queries (topics, learned sentiment). Model output is not
bit-comparable with another engine, so these are rows-only checks backed by
invariant tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import sentiment as SE
from ..operators import text_ops as TO
from ..operators import topics as TP
from ..operators.coherence import coherence_cv_per_topic
from ..operators.common import attach_scalars, materialize
from ..operators.vocab import bag_of_words, vocabulary
from ..sources.tables import doc_labels, docs, read_table
from .registry import finish, register
from .textual import doc_tokens

K_FINAL = 5
PASSES = 12
SEARCH_PASSES = 8


# The final model of each corpus that this application has fitted; its tables are checkpoints.
_FITTED: dict = {}


def _fit(spark, sf, k=K_FINAL):
    """One fit serves all queries of a session that read the final model."""
    key = spark.sparkContext.applicationId, sf, k
    if key not in _FITTED:
        _FITTED.clear()
        t = doc_tokens(spark, sf, materialized=True)
        vec, vocab_df, _ = TP.prepare_corpus(t, "doc_id")
        _FITTED[key] = t, vec, vocab_df, TP.fit_lda(vec, k, PASSES)
    return _FITTED[key]


@register("lda_topics")
def q_lda_topics(spark, sf):
    """E1 + E5: top-10 words per topic with weights."""
    _, _, vocab_df, m = _fit(spark, sf)
    return finish(TP.topic_top_words(m, vocab_df, 10))


@register("lda_dominant")
def q_lda_dominant(spark, sf):
    """Dominant topic and strength for every document."""
    _, vec, _, m = _fit(spark, sf)
    return finish(TP.dominant_topic(TP.doc_topics(m, vec, "doc_id"), "doc_id", K_FINAL))


@register("lda_proportions")
def q_lda_proportions(spark, sf):
    """E4 + H4: token-weighted topic shares and their rank."""
    _, vec, _, m = _fit(spark, sf)
    return finish(TP.topic_proportions(TP.doc_topics(m, vec, "doc_id")))


@register("lda_rank_relabel")
def q_lda_rank_relabel(spark, sf):
    """Dominant topics relabelled by share rank."""
    _, vec, _, m = _fit(spark, sf)
    th = materialize(TP.doc_topics(m, vec, "doc_id"))
    return finish(TP.rank_relabel(TP.dominant_topic(th, "doc_id", K_FINAL), TP.topic_proportions(th)))


@register("lda_relevance")
def q_lda_relevance(spark, sf):
    """Top-30 terms per topic by relevance (lambda 0.6)."""
    t, vec, vocab_df, m = _fit(spark, sf)
    bow = bag_of_words(t, vocab_df.select("term"), "doc_id")
    return finish(TP.term_relevance(m, vocab_df, bow, 0.6, 30))


@register("lda_coherence")
def q_lda_coherence(spark, sf):
    """c_v per topic of the final model."""
    t, vec, vocab_df, m = _fit(spark, sf)
    return finish(coherence_cv_per_topic(t, TP.topic_top_words(m, vocab_df, 20)))


@register("lda_k_search")
def q_lda_k_search(spark, sf):
    """Coherence for every k in the reference range, best flagged."""
    t = doc_tokens(spark, sf, materialized=True)
    return finish(TP.k_search(None, t, vocabulary(t), TP.k_range(t.count()), SEARCH_PASSES))


@register("lda_subtopics")
def q_lda_subtopics(spark, sf):
    """Subtopic id per document inside each language (main topic)."""
    d = docs(spark, sf).select("doc_id", "lang", "text")
    out = TP.subtopics(d, "doc_id", "lang", "text")
    return out.groupBy("lang", "comment_subtopic").agg(F.count(F.lit(1)).alias("n_docs"))


_TOPIC_OK = "SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_ids, true AS in_range FROM documents"


@register("topic_pipeline_invariants", _TOPIC_OK)
def q_topic_pipeline_invariants(spark, sf):
    """E1 + E2 + C6 + C7 + C8 as one plan (lemma text, phrases, vocabulary, k search, final fit with
    the best k): one row per document, every topic below k, every strength in (0, 1]."""
    lem = TO.lemma_text(docs(spark, sf).select("doc_id", TX.clean_text("text").alias("t")), "t")
    toks = TO.topic_tokens(lem, "text_lem").select("doc_id", "tokens")
    model, vec, _, _, rows = TP.topic_pipeline(toks, "doc_id")
    k = TP.best_k(rows)
    dom = TP.dominant_topic(TP.doc_topics(model, vec, "doc_id"), "doc_id", k)
    ok = F.col("topic_id").between(0, k - 1) & (F.col("topic_strength") > 0) & (F.col("topic_strength") <= 1 + 1e-9)
    return dom.agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("doc_id").alias("n_ids"),
                   F.coalesce(F.bool_and(ok), F.lit(True)).alias("in_range"))


@register("lda_invariants", """SELECT 5 AS n_topics, CAST(1.0 AS DOUBLE) AS share_sum, CAST(count(*) AS BIGINT) AS n_docs FROM documents""")
def q_lda_invariants(spark, sf):
    """Five topics whose token-weighted shares sum to 1, one dominant topic a document."""
    _, vec, _, m = _fit(spark, sf)
    th = materialize(TP.doc_topics(m, vec, "doc_id"))
    shares = TP.topic_proportions(th).agg(F.count(F.lit(1)).cast("int").alias("n_topics"),
                                          F.round(F.sum("share"), 9).alias("share_sum"))
    return attach_scalars(shares, TP.dominant_topic(th, "doc_id", K_FINAL).agg(F.count(F.lit(1)).alias("n_docs")))


# Mixtures that both engines can derive: the first five vector components, absolute and scaled to 1.
_THETA_SQL = """WITH th AS (
  SELECT vec_id, CAST(vec_id % 50 AS BIGINT) AS doc_len, [abs(CAST(x AS DOUBLE)) FOR x IN embedding[1:5]] AS t FROM embeddings),
tn AS (SELECT vec_id, doc_len, [x / list_sum(t) FOR x IN t] AS theta FROM th),
pr AS (
  SELECT topic, mass / sum(mass) OVER () AS share,
         CAST(row_number() OVER (ORDER BY mass DESC, topic) AS INTEGER) AS rank
  FROM (SELECT CAST(topic AS INTEGER) AS topic, sum(theta[topic + 1] * doc_len) AS mass
        FROM (SELECT *, unnest(range(0, 5)) AS topic FROM tn) WHERE doc_len > 0 GROUP BY 1)),
dm AS (
  SELECT vec_id, CAST(list_position(theta, list_max(theta)) - 1 AS INTEGER) AS topic_id,
         list_max(theta) AS topic_strength FROM tn)
"""


def _theta(spark, sf):
    v = F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(x.cast("double")))
    total = F.aggregate("t", F.lit(0.0), lambda a, x: a + x)
    return (read_table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("doc_len"), v.alias("t"))
            .select("vec_id", "doc_len", F.transform("t", lambda x: x / total).alias("theta")))


@register("mixture_proportions", _THETA_SQL + "SELECT topic, round(share, 6) AS share, rank FROM pr")
def q_mixture_proportions(spark, sf):
    """E4 + H4 over given mixtures."""
    return finish(TP.topic_proportions(_theta(spark, sf)))


@register("mixture_dominant", _THETA_SQL + "SELECT vec_id, topic_id, round(topic_strength, 6) AS topic_strength FROM dm")
def q_mixture_dominant(spark, sf):
    """E6 over given mixtures."""
    return finish(TP.dominant_topic(_theta(spark, sf), "vec_id", 5))


@register("mixture_rank_relabel", _THETA_SQL + """
SELECT dm.vec_id, dm.topic_id, round(dm.topic_strength, 6) AS topic_strength, pr.rank AS topic_rank
FROM dm LEFT JOIN pr ON dm.topic_id = pr.topic""")
def q_mixture_rank_relabel(spark, sf):
    """E7 over given mixtures."""
    th = _theta(spark, sf)
    return finish(TP.rank_relabel(TP.dominant_topic(th, "vec_id", 5), TP.topic_proportions(th)))


@register("model_sentiment")
def q_model_sentiment(spark, sf):
    """D4 + D6: default learned scorer trained on the label table, applied to every document."""
    d = docs(spark, sf).select("doc_id", "text")
    train = d.join(doc_labels(spark, sf), "doc_id")
    model = SE.fit_text_classifier(train, "text", "label")
    return finish(SE.apply_text_classifier(model, d, "text"))
