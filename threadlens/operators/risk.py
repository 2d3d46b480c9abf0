"""Most negative topics and subtopics.

Inputs are per-topic / per-subtopic distribution tables (one row per key),
so the top-k here are TakeOrderedAndProject over small frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import topic_subtopic_key


def top_negative_topics(topic_dist: DataFrame, model: str = "bert", n: int = 5) -> DataFrame:
    """The ``n`` topics with the highest negative share (ties -> topic order)."""
    c = f"{model}_neg_pct"
    return (topic_dist.orderBy(F.desc(c), F.asc("topic")).limit(n)
            .select(F.lit(model).alias("model"), "topic", F.col(c).alias("neg_pct"), "n_rows"))


def top_negative_subtopics(sub_dist: DataFrame, model: str = "bert", n: int = 10) -> DataFrame:
    """I2 + B10: the ``n`` (topic, subtopic) cells with the highest negative share,
    with their ``T{t}-S{s}`` label."""
    c = f"{model}_neg_pct"
    return (sub_dist.orderBy(F.desc(c), F.asc("topic"), F.asc("subtopic")).limit(n)
            .select(F.lit(model).alias("model"), "topic", "subtopic",
                    topic_subtopic_key("topic", "subtopic").alias("label"),
                    F.col(c).alias("neg_pct"), "n_rows"))


def risk_model_compare(topic_dist: DataFrame, n: int = 5) -> DataFrame:
    """G4 + J2: full outer combine of both models' top-n lists by topic; a topic
    missing from one list gets 0 for that model."""
    b = top_negative_topics(topic_dist, "bert", n).select("topic", F.col("neg_pct").alias("bert"))
    v = top_negative_topics(topic_dist, "vader", n).select("topic", F.col("neg_pct").alias("vader"))
    return b.join(v, "topic", "full_outer").select(
        "topic", F.coalesce("bert", F.lit(0.0)).alias("bert"), F.coalesce("vader", F.lit(0.0)).alias("vader"))


def topic_extremes(topic_dist: DataFrame) -> DataFrame:
    """most negative and most positive topic per model (first topic on ties)."""
    kinds = [(m, k, f"{m}_{c}_pct") for m in ("bert", "vader") for k, c in (("most_negative", "neg"), ("most_positive", "pos"))]
    # All four in one aggregate over the topic table; -topic lets the first topic win ties.
    best = [F.max_by(F.struct("topic", F.col(c).alias("pct"), "n_rows"), F.struct(F.col(c), -F.col("topic"))).alias(f"_{i}")
            for i, (_, _, c) in enumerate(kinds)]
    rows = [F.struct(F.lit(m).alias("model"), F.lit(k).alias("kind"), F.col(f"_{i}").alias("r")) for i, (m, k, _) in enumerate(kinds)]
    return (topic_dist.agg(*best).select(F.explode(F.array(*rows)).alias("x"))
            .select("x.model", "x.kind", "x.r.topic", "x.r.pct", "x.r.n_rows").where("topic is not null"))


def topic_neg_mean_sd(topic_dist: DataFrame) -> DataFrame:
    """unweighted mean and sample SD of each model's negative share over topics."""
    return topic_dist.agg(
        F.avg("bert_neg_pct").alias("bert_mean"), F.stddev_samp("bert_neg_pct").alias("bert_sd"),
        F.avg("vader_neg_pct").alias("vader_mean"), F.stddev_samp("vader_neg_pct").alias("vader_sd"),
        F.count(F.lit(1)).alias("n_topics"))


def subtopic_spread_max(sub_dist: DataFrame, model: str = "bert") -> DataFrame:
    """topic whose subtopics' negative shares have the largest sample SD
    (topics with a single subtopic have no SD and are skipped)."""
    c = f"{model}_neg_pct"
    sd = (sub_dist.groupBy("topic").agg(F.stddev_samp(c).alias("sd"), F.count(F.lit(1)).alias("n_subtopics"))
          .filter(F.col("sd").isNotNull() & ~F.isnan("sd")))
    return sd.orderBy(F.desc("sd"), F.asc("topic")).limit(1)
