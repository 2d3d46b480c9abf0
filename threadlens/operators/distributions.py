"""Label and topic distributions.

All of these are hash aggregates with map-side partial aggregation, so a hot
key (a topic holding a third of the rows) is pre-reduced in every map task
before the shuffle. Windows only ever run over already-aggregated tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import (LEXICON_LABEL_CANDIDATES, MODEL_LABEL_CANDIDATES, SUBTOPIC_CANDIDATES,
                       TIME_CANDIDATES, TOPIC_CANDIDATES, first_existing, require_one)
from ..functions.labels import LABELS, is_label, null_bucket
from ..functions.timeaxis import coerce_time, period_key
from .common import attach_scalars, label_share_aggs


def with_period(df: DataFrame, period: str, time_col: str | None = None,
                out: str | None = None) -> DataFrame:
    """Resolve the time column, coerce it (K1), drop unparsable rows (B6), add the period key."""
    tc = time_col or require_one(df, TIME_CANDIDATES, "time")
    t = coerce_time(df, tc)
    return df.withColumn("_t", t).filter(F.col("_t").isNotNull()) \
             .withColumn(out or period, period_key(F.col("_t"), period)).drop("_t")


# ---------------------------------------------------------------- F1 / F6 / F38

def overall_label_shares(df: DataFrame, lexicon_label: str = "vader_label",
                         model_label: str = "bert_label") -> DataFrame:
    """both models' label shares over all rows (NULL label counts in the denominator) + n_rows."""
    aggs = []
    for col, p in ((lexicon_label, "vader"), (model_label, "bert")):
        for v in ("positive", "neutral", "negative"):
            aggs.append(F.avg(is_label(col, v)).alias(f"{p}_{v}_pct"))
    return df.agg(*aggs, F.count(F.lit(1)).alias("n_rows"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """counts per label value, NULL kept as its own group."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_counts_ordered(df: DataFrame, label: str, labels=LABELS) -> DataFrame:
    """counts in the fixed order negative, neutral, positive; absent labels -> 0."""
    spark = df.sparkSession
    order = spark.createDataFrame([(v, i) for i, v in enumerate(labels)], "label string, label_order int")
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return (order.join(counts, "label", "left")
            .select("label", "label_order", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


# ---------------------------------------------------------------- F2 / F3 (H1)

def first_row_per_post(df: DataFrame, post_col: str, order_cols, cols) -> DataFrame:
    """H1: the first row of every post under an explicit total order.

    ``min_by`` over a struct is a partial aggregate: each map task keeps one
    candidate per post, so a post with millions of comments never has its
    rows gathered in one place (a ``row_number`` window would).
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    picked = F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("_first")
    return df.groupBy(post_col).agg(picked).select(post_col, "_first.*")


def post_summary_by_topic(df: DataFrame, order_cols, post_col: str = "post_id",
                          topic_col: str | None = None) -> DataFrame:
    """posts de-duplicated (first row), then per topic: distinct posts, six label
    shares (NULL label in the denominator), mean compound, mean model score.
    NULL topics are dropped (pandas groupby)."""
    tc = topic_col or require_one(df, TOPIC_CANDIDATES, "topic")
    first = first_row_per_post(df, post_col, order_cols,
                               [tc, "vader_label", "bert_label", "vader_compound", "bert_score"])
    return (first.filter(F.col(tc).isNotNull()).groupBy(tc).agg(
        F.count_distinct(post_col).alias("total_posts"),
        *label_share_aggs("vader_label", LABELS[::-1], "vader", True),
        *label_share_aggs("bert_label", LABELS[::-1], "bert", True),
        F.avg("vader_compound").alias("vader_compound_avg"),
        F.avg("bert_score").alias("bert_score_avg")))


def comment_summary_by_subtopic(df: DataFrame, topic_col: str | None = None,
                                subtopic_col: str = "comment_subtopic",
                                comment_col: str = "comment_id") -> DataFrame:
    """per (topic, subtopic), rows with either key NULL dropped; n_comments counts
    non-null comment ids; same eight measures as F2."""
    tc = topic_col or require_one(df, TOPIC_CANDIDATES, "topic")
    return (df.filter(F.col(tc).isNotNull() & F.col(subtopic_col).isNotNull())
            .groupBy(tc, subtopic_col).agg(
                F.count(comment_col).alias("n_comments"),
                *label_share_aggs("vader_label", LABELS[::-1], "vader", True),
                *label_share_aggs("bert_label", LABELS[::-1], "bert", True),
                F.avg("vader_compound").alias("vader_compound_avg"),
                F.avg("bert_score").alias("bert_score_avg")))


# ---------------------------------------------------------------- F4 / F5 / F12 / F13

def _label_cols(df, lexicon_label, model_label):
    v = lexicon_label or first_existing(df, LEXICON_LABEL_CANDIDATES)
    b = model_label or first_existing(df, MODEL_LABEL_CANDIDATES)
    if v is None and b is None:
        raise ValueError("no sentiment label column found")
    return v, b


def _dist_aggs(v, b):
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if v:
        aggs += label_share_aggs(v, LABELS[::-1], "vader", False)
    if b:
        aggs += label_share_aggs(b, LABELS[::-1], "bert", False)
    return aggs


def topic_label_distribution(df: DataFrame, topic_col: str | None = None,
                             lexicon_label: str | None = None, model_label: str | None = None) -> DataFrame:
    """per topic (NULL -> "None"): n_rows and both models' shares with the
    denominator = non-null labels; an absent label gives 0."""
    tc = topic_col or first_existing(df, TOPIC_CANDIDATES)
    v, b = _label_cols(df, lexicon_label, model_label)
    key = null_bucket(tc) if tc else F.lit("None")
    return df.groupBy(key.alias("topic")).agg(*_dist_aggs(v, b))


def subtopic_label_distribution(df: DataFrame, topic_col: str | None = None,
                                subtopic_col: str | None = None,
                                lexicon_label: str | None = None, model_label: str | None = None) -> DataFrame:
    """as F4 keyed by (topic, subtopic); rows with a NULL key are dropped."""
    tc = topic_col or require_one(df, TOPIC_CANDIDATES, "topic")
    sc = subtopic_col or require_one(df, SUBTOPIC_CANDIDATES, "subtopic")
    v, b = _label_cols(df, lexicon_label, model_label)
    return (df.filter(F.col(tc).isNotNull() & F.col(sc).isNotNull())
            .groupBy(F.col(tc).alias("topic"), F.col(sc).alias("subtopic")).agg(*_dist_aggs(v, b)))


def label_matrix(df: DataFrame, key_col: str, label: str, labels=LABELS) -> DataFrame:
    """Key x label share matrix (row-normalised over non-null labels,
    NULL keys dropped). Wide: one column per label."""
    g = df.filter(F.col(key_col).isNotNull() & F.col(label).isNotNull())
    aggs = [F.sum(F.when(F.col(label) == v, 1).otherwise(0)).alias(v) for v in labels]
    return (g.groupBy(key_col).agg(F.count(label).alias("_n"), *aggs)
            .select(key_col, *[(F.col(v) / F.col("_n")).alias(v) for v in labels]))


# ---------------------------------------------------------------- F7 / F8 / F9 / F10

def label_share_by_period(df: DataFrame, label: str, period: str = "year",
                          time_col: str | None = None, labels=LABELS) -> DataFrame:
    """Share of each label per year/month; denominator = non-null labels
    of the period (labels outside ``labels`` still count in it)."""
    g = with_period(df, period, time_col).filter(F.col(label).isNotNull())
    aggs = [F.sum(F.when(F.col(label) == v, 1).otherwise(0)).alias(v) for v in labels]
    return (g.groupBy(period).agg(F.count(F.lit(1)).alias("_n"), *aggs)
            .select(period, *[(F.col(v) / F.col("_n")).alias(v) for v in labels]))


def topic_share_by_period(df: DataFrame, period: str = "month", time_col: str | None = None,
                          topic_col: str | None = None) -> DataFrame:
    """F9 / F10 (long form): n and share of each topic within its period (H3).

    The window runs over the aggregated (period, topic) table only.
    """
    tc = topic_col or require_one(df, TOPIC_CANDIDATES, "topic")
    g = with_period(df, period, time_col).filter(F.col(tc).isNotNull())
    counts = g.groupBy(period, F.col(tc).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(period)))


def monthly_volume_negative(df: DataFrame, label: str, time_col: str | None = None) -> DataFrame:
    """per month, volume = non-null labels, neg_share = share of 'negative'
    over all rows of the month (a NULL label counts in the denominator)."""
    g = with_period(df, "month", time_col)
    return g.groupBy("month").agg(
        F.count(label).alias("volume"),
        F.avg(is_label(label, "negative")).alias("neg_share"))


def volume_regression(monthly: DataFrame) -> DataFrame:
    """least-squares line of neg_share on volume over the monthly table."""
    return monthly.agg(
        F.regr_slope("neg_share", "volume").alias("slope"),
        F.regr_intercept("neg_share", "volume").alias("intercept"),
        F.regr_r2("neg_share", "volume").alias("r2"),
        F.corr("volume", "neg_share").alias("r"),
        F.count(F.lit(1)).alias("n_months"))


# ---------------------------------------------------------------- F36 / F37

def user_counts(df: DataFrame, user_col: str) -> DataFrame:
    """rows per user, NULL -> "UNKNOWN"."""
    return df.groupBy(null_bucket(user_col, "UNKNOWN").alias("user")).agg(
        F.count(F.lit(1)).alias("n_posts"))


def histogram(values: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """equal-width histogram with ``bins`` bins between min and max (last bin
    closed; min == max spreads over +/-0.5). Every bin is emitted, empty ones with 0."""
    b = values.agg(F.min(col).cast("double").alias("_lo0"), F.max(col).cast("double").alias("_hi0"))
    b = b.select(F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                 F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.least(F.floor((F.col(col) - F.col("_lo")) / width).cast("int"), F.lit(bins - 1))
    counted = (attach_scalars(values.select(col), b).groupBy(idx.alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    grid = b.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi")
    w = (F.col("_hi") - F.col("_lo")) / bins
    return (grid.join(counted, "bin", "left")
            .select("bin", (F.col("_lo") + F.col("bin") * w).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_end"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


# ---------------------------------------------------------------- F39 / F40 / F41 / F42

def label_pct_by_topic_name(df: DataFrame, topic_names: DataFrame, label: str,
                            topic_col: str = "topic_id", labels=LABELS) -> DataFrame:
    """E10 + F39: attach topic names (left join on a small name table, unknown id -> NULL
    name) and give label percentages (x100, absent -> 0) per name."""
    named = df.join(topic_names, topic_col, "left")
    g = named.filter(F.col(label).isNotNull())
    aggs = [(100.0 * F.sum(F.when(F.col(label) == v, 1).otherwise(0)) / F.count(label)).alias(v)
            for v in labels]
    return g.groupBy("topic_label").agg(*aggs)


def mean_compound_by_topic_name(df: DataFrame, topic_names: DataFrame, compound: str = "vader_compound",
                                topic_col: str = "topic_id") -> DataFrame:
    """mean compound per topic name, highest first."""
    named = df.join(topic_names, topic_col, "left")
    return (named.groupBy("topic_label").agg(F.avg(compound).alias("mean_compound"))
            .orderBy(F.desc("mean_compound"), F.asc_nulls_last("topic_label")))


def stacked_offsets(shares: DataFrame, key_cols, prefix: str) -> DataFrame:
    """stacked-bar bases per key: positive at 0, neutral on positive,
    negative on positive + neutral (long form: key, label, share, base)."""
    order = [("positive", f"{prefix}_pos_pct"), ("neutral", f"{prefix}_neu_pct"),
             ("negative", f"{prefix}_neg_pct")]
    parts = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(l).alias("label"), F.col(c).alias("share"))
                      for i, (l, c) in enumerate(order)])
    long = shares.select(*key_cols, F.explode(parts).alias("p")).select(*key_cols, "p.*")
    w = Window.partitionBy(*key_cols).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return long.withColumn("base", F.coalesce(F.sum("share").over(w), F.lit(0.0))).drop("rank")


# ---------------------------------------------------------------- O1 / O2 / O3 (stated, optional)

def engagement_by_post(df: DataFrame, order_cols, post_col: str = "post_id", label: str = "bert_label",
                       score_col: str = "comment_score", topic_col: str = "topic_id") -> DataFrame:
    """O1: comments and summed comment score per post, with the post's topic and first-row polarity."""
    from ..functions.labels import polarity
    order = F.struct(*[F.col(c) for c in order_cols])
    return df.groupBy(post_col).agg(
        F.count(F.lit(1)).alias("n_comments"), F.sum(score_col).alias("score_sum"),
        F.min_by(F.col(topic_col), order).alias("topic"),
        F.min_by(polarity(label), order).alias("post_polarity"))


def engagement_correlation(per_post: DataFrame) -> DataFrame:
    """O1: per topic, Pearson r of comment volume with the post's polarity."""
    return per_post.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_posts"), F.avg("n_comments").alias("mean_comments"),
        F.corr("n_comments", "post_polarity").alias("r_volume_polarity"))


def min_length(df: DataFrame, text_col: str, n: int) -> DataFrame:
    """O3: keep texts of at least ``n`` characters."""
    return df.filter(F.length(F.coalesce(F.col(text_col), F.lit(""))) >= n)
