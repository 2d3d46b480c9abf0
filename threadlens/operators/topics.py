"""Topic modelling.

One final model is fitted by ``lda`` over term counts made once against the vocabulary
(C8) and written; its k x V topic-term weights follow the vocabulary's df bounds. Where
many models are compared (the k search, a model inside every main topic) they are fitted
together by ``topic_batch``, with weights and mixtures as tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from . import lda
from .common import attach_scalars, materialize, release
from .topic_batch import best_ks, coherence_of, fit_documents, scored
from .vocab import numbered_vocabulary, vocabulary


def prepare_corpus(docs: DataFrame, doc_col: str, tokens_col: str = "tokens", no_below: int = 5,
                   no_above: float = 0.5, keep_n: int | None = None):
    """Vocabulary (C8) + term counts of every document, counted where the row stands.

    Returns (vectors [doc, n_own, last, cells], vocab DataFrame [term_id, term], number of terms).
    """
    # Materialised once: the numbering reads it several times.
    vocab = materialize(vocabulary(docs.select(doc_col, tokens_col), tokens_col, no_below, no_above, keep_n))
    vocab_df, terms = numbered_vocabulary(vocab)
    return materialize(lda.counted(docs, terms, doc_col, tokens_col)), vocab_df, len(terms)


def fit_lda(vectors: DataFrame, k: int, passes: int = 12, seed: int = 42) -> lda.Topics:
    """Online variational LDA, symmetric priors 1/k, ``passes`` full-corpus iterations."""
    return lda.fit(vectors, k, passes, seed)


def doc_topics(model: lda.Topics, vectors: DataFrame, doc_col: str) -> DataFrame:
    """Per-document topic mixture as array<double> (``theta``); ``doc_len`` counts the tokens of all rows of
    the document's key (a NULL key: 0)."""
    lens = vectors.groupBy(doc_col).agg(F.sum("n_own").alias("doc_len"))
    rows = model.mixtures(vectors, doc_col).join(lens, doc_col, "left")
    return rows.select(doc_col, F.coalesce("doc_len", F.lit(0)).cast("long").alias("doc_len"), "theta")


def dominant_topic(theta: DataFrame, doc_col: str, k: int, empty: str = "first") -> DataFrame:
    """Argmax topic (lowest id on ties) and its probability.

    An empty document gets an all-zero mixture from Spark; ``empty='first'``
    maps it to topic 0 with strength 1/k (a uniform mixture's argmax),
    ``empty='null'`` leaves topic NULL and strength 0.
    """
    mx = F.array_max("theta")
    zero = (mx <= 0) | mx.isNull()
    tid = F.array_position("theta", mx) - 1
    if empty == "first":
        topic = F.when(zero, F.lit(0)).otherwise(tid)
        strength = F.when(zero, F.lit(1.0 / k)).otherwise(mx)
    else:
        topic = F.when(zero, F.lit(None)).otherwise(tid)
        strength = F.when(zero, F.lit(0.0)).otherwise(mx)
    return theta.select(doc_col, topic.cast("int").alias("topic_id"), strength.alias("topic_strength"))


def topic_proportions(theta: DataFrame) -> DataFrame:
    """E4 + H4: token-weighted share of each topic, rank 1 = largest (ties -> lower id).

    The rank window runs over the k-row aggregate only.
    """
    ex = theta.filter(F.col("doc_len") > 0).select("doc_len", F.posexplode("theta").alias("topic", "p"))
    tot = ex.groupBy("topic").agg(F.sum(F.col("p") * F.col("doc_len")).alias("mass"))
    allm = tot.agg(F.sum("mass").alias("_all"))
    shares = attach_scalars(tot, allm).select("topic", (F.col("mass") / F.col("_all")).alias("share"))
    return shares.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("share"), F.asc("topic"))))


def rank_relabel(dominant: DataFrame, proportions: DataFrame) -> DataFrame:
    """Replace model topic ids by their 1-based share rank (small broadcast join)."""
    r = F.broadcast(proportions.select(F.col("topic").alias("topic_id"), F.col("rank").alias("topic_rank")))
    return dominant.join(r, "topic_id", "left")


def topic_top_words(model, vocab_df: DataFrame, n: int = 10) -> DataFrame:
    """E5: the ``n`` highest-weight terms per topic with weights and rank."""
    return model.top_terms(n).join(vocab_df, "term_id").select("topic", "rank", "term", "weight")


def term_relevance(model, vocab_df: DataFrame, bow: DataFrame, lam: float = 0.6, n: int = 30) -> DataFrame:
    """relevance = lam*log(phi) + (1-lam)*log(phi / p(w)), top ``n`` terms per topic.

    phi comes from the fitted topic-term weights (bounded by the vocabulary),
    p(w) from corpus term counts.
    """
    phi = model.phi()
    tf = bow.groupBy("term").agg(F.sum("count").alias("tf"))
    tot = tf.agg(F.sum("tf").alias("_tot"))
    pw = attach_scalars(tf, tot).select("term", (F.col("tf") / F.col("_tot")).alias("p_w"))
    j = phi.join(vocab_df, "term_id").join(pw, "term")
    rel = lam * F.log("phi") + (1 - lam) * F.log(F.col("phi") / F.col("p_w"))
    j = j.withColumn("relevance", rel)
    w = Window.partitionBy("topic").orderBy(F.desc("relevance"), F.asc("term"))
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n) \
            .select("topic", "rank", "term", "phi", "p_w", "relevance")


def best_k(rows: list[tuple]) -> int:
    """The k of highest coherence, ties to the smallest."""
    return max(rows, key=lambda r: (r[1] if r[1] is not None else float("-inf"), -r[0]))[0]


def k_search(vectors: DataFrame | None, texts: DataFrame, vocab_df: DataFrame, ks, passes: int = 8,
             seed: int = 42, tokens_col: str = "tokens", topn: int = 20) -> DataFrame:
    """(k, coherence, best) for every k, over the terms of ``vocab_df``. All models are fitted
    together (see ``topic_batch``) from the texts' counts; ``vectors`` are not needed."""
    ks = list(ks)
    if not ks:
        raise ValueError("k search needs a non-empty k range (corpus too small)")
    # Rows are told apart by a number of their own: keys may repeat or be NULL.
    own = texts.select(F.lit(0).cast("long").alias("g"), F.monotonically_increasing_id().alias("doc"),
                       F.col(tokens_col).alias("tokens"))
    return scored(fit_documents(own, ks, passes, seed, infer=False, terms=vocab_df), own, topn)


def topic_pipeline(docs: DataFrame, doc_col: str, tokens_col: str = "tokens", ks=None, search_passes: int = 8,
                   passes: int = 12, seed: int = 42, phrase_min_count: int = 5, phrase_threshold: float = 10.0,
                   no_below: int = 5, no_above: float = 0.5):
    """The main plan (E1, E2): phrases, vocabulary, k search, final fit with the best k.

    Returns ``(model, vectors, vocabulary, phrased documents, [(k, coherence)])``.
    """
    from .phrases import learn_and_merge

    found, _, _ = learn_and_merge(docs, doc_col, tokens_col, phrase_min_count, phrase_threshold)
    merged = materialize(found.select(doc_col, F.col("phrased").alias("tokens")))
    release(found)
    vectors, vocab_df, _ = prepare_corpus(merged, doc_col, "tokens", no_below, no_above)
    found = k_search(None, merged, vocab_df, ks or k_range(merged.count()), search_passes, seed)
    rows = [(r.k, r.coherence) for r in found.orderBy("k").collect()]
    return fit_lda(vectors, best_k(rows), passes, seed), vectors, vocab_df, merged, rows


def k_range(n_docs: int, k_min: int = 3, k_max: int = 10) -> list:
    """Reference k bounds: k_min .. min(k_max, max(2, n_docs // 2))."""
    return list(range(max(k_min, 2), min(k_max, max(2, n_docs // 2)) + 1))


def subtopics(df: DataFrame, doc_col: str, topic_col: str, text_col: str, min_docs: int = 30,
              k_min: int = 2, k_max: int = 8, passes: int = 6, phrase_min_count: int = 3,
              phrase_threshold: float = 8.0, no_below: int = 5, no_above: float = 0.5,
              seed: int = 42) -> DataFrame:
    """E8 (+ B7, B8, J4, G6): a separate topic model inside every main topic.

    For each main topic (distinct non-NULL ids except -1): non-blank texts,
    tokens, documents left with no token dropped, at least ``min_docs``
    documents before and after tokenising, phrases (C6/C7), vocabulary, k
    search over k_min..k_max by c_v, dominant subtopic per document. Rows without a
    subtopic get -1. All main topics and all k are learned in one set of jobs, whatever
    their number: phrases, vocabulary, models, coherence and the choice of k are keyed by
    main topic.
    """
    from .phrases import phrases_in_groups
    from .text_ops import topic_tokens

    # Rows are told apart by a number of their own: keys may repeat or be NULL.
    df = materialize(df.withColumn("_rid", F.monotonically_increasing_id()))
    base = gated_texts(df.select("_rid", topic_col, text_col), topic_col, text_col)
    toks = materialize(topic_tokens(base, text_col).select(F.col("_rid").alias("doc"), F.col(topic_col).alias("_main"), "tokens"))
    plan = materialize(eligible_groups(toks, min_docs))
    sub = toks.where(F.size("tokens") > 0).join(plan, "_main").select("g", "doc", "tokens")
    found = phrases_in_groups(sub, phrase_min_count, phrase_threshold)
    merged = materialize(found)
    # Only the merged texts are read from here on.
    release(found)
    release(toks)
    fitted = fit_documents(merged, range(k_min, k_max + 1), passes, seed, bounds=(no_below, no_above))
    limit = F.least(F.lit(k_max), F.greatest(F.lit(2), F.floor(F.col("n_tok") / 2)))
    scores = coherence_of(fitted, merged).join(plan.select("g", "n_tok"), "g").where(F.col("k") <= limit)
    best = materialize(best_ks(scores))
    theta = F.coalesce(*[F.when(F.col("k") == k, fitted.theta_column(k)) for k in fitted.ks])
    own = fitted.mixtures.join(best, "g").select("doc", "k", theta.alias("theta"))
    topic = F.array_position("theta", F.array_max("theta")) - 1
    res = own.select(F.col("doc").alias("_rid"), topic.cast("int").alias("comment_subtopic"),
                     F.col("k").alias("n_subtopics"))
    out = df.join(res, "_rid", "left").drop("_rid")
    return out.withColumn("comment_subtopic", F.coalesce("comment_subtopic", F.lit(-1)))


def gated_texts(df: DataFrame, topic_col: str, text_col: str) -> DataFrame:
    """Rows of a main topic (not NULL, not -1) with a text that isn't blank."""
    return df.filter(F.col(topic_col).isNotNull() & (F.col(topic_col).cast("string") != "-1") & ~is_blank(text_col))


def eligible_groups(toks: DataFrame, min_docs: int) -> DataFrame:
    """``_main, g, n_all, n_tok`` of main topics with at least ``min_docs`` documents, before and
    after those without tokens are left out; ``g`` numbers them."""
    sizes = toks.groupBy("_main").agg(F.count(F.lit(1)).alias("n_all"),
                                      F.sum(F.when(F.size("tokens") > 0, 1).otherwise(0)).alias("n_tok"))
    return sizes.where((F.col("n_all") >= min_docs) & (F.col("n_tok") >= min_docs)).withColumn(
        "g", F.monotonically_increasing_id())
