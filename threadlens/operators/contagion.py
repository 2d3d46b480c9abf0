"""Post -> comment sentiment relation.

One ``groupBy(post_id)`` computes the post's polarity (label of its first
row, H1/H2 via ``min_by``) and the mean polarity of all its rows (F22)
together, replacing the reference's dedupe + group + inner join (G1) with a
single partial aggregate: no window, no join, and a hot post is pre-reduced
map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import polarity
from ..functions.stats import pearson_p_col

# Alignment bins (right-closed) and their names.
ALIGN_BINS = [(-2.0, -0.5, "Negative"), (-0.5, 0.5, "Neutral"), (0.5, 2.0, "Positive")]


def post_comment_pairs(df: DataFrame, label: str, order_cols, post_col: str = "post_id",
                       comment_col: str = "comment_id", mode: str = "first_row",
                       post_label_col: str | None = None) -> DataFrame:
    """F21 + F22 + G1: per post, ``post_score`` = polarity of the post's label,
    ``avg_comment_score`` = share positive - share negative over its rows (NULL label
    counts as 0), plus the comment count and the post's label (G2).

    ``mode='first_row'`` (reference behaviour): the post's label is the first label
    that is not NULL (H2) in row order, which is also inside the average.
    ``mode='post_text'``: the post's label is ``post_label_col`` (a label scored
    on the post's own text, constant per post) and the average covers comments only.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    if mode == "first_row":
        post_label = F.min_by(F.col(label), F.when(F.col(label).isNotNull(), order))
    elif mode == "post_text":
        if not post_label_col:
            raise ValueError("mode='post_text' needs post_label_col")
        post_label = F.min_by(F.col(post_label_col), order)
    else:
        raise ValueError("mode must be 'first_row' or 'post_text'")
    return df.groupBy(post_col).agg(
        post_label.alias("post_label"),
        F.avg(polarity(label).cast("double")).alias("avg_comment_score"),
        F.count(comment_col).alias("n_comments"),
    ).withColumn("post_score", polarity("post_label"))


def post_comment_correlation(pairs: DataFrame, min_posts: int = 10) -> DataFrame:
    """F24 + F25 + F26 + F35: Pearson r (only with more than ``min_posts`` posts),
    its two-sided p, least-squares slope/intercept, strength and direction."""
    g = pairs.agg(F.corr("post_score", "avg_comment_score").alias("_r"),
                  F.regr_slope("avg_comment_score", "post_score").alias("slope"),
                  F.regr_intercept("avg_comment_score", "post_score").alias("intercept"),
                  F.count(F.lit(1)).alias("n_posts"))
    r = F.when(F.col("n_posts") > min_posts, F.col("_r"))
    g = g.withColumn("r", r)
    return g.select(
        "n_posts", "r", pearson_p_col("r", "n_posts").alias("p_value"), "slope", "intercept",
        F.when(F.abs("r") > 0.5, "strong").when(F.abs("r") > 0.3, "moderate").otherwise("weak").alias("strength"),
        F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none").alias("direction"))


def align_bin(x) -> F.Column:
    """right-closed bins (-2,-0.5], (-0.5,0.5], (0.5,2]; outside -> NULL."""
    c = F.col(x) if isinstance(x, str) else x
    out = None
    for lo, hi, name in ALIGN_BINS:
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def alignment_matrix(pairs: DataFrame) -> DataFrame:
    """(post bin, comment bin) counts and row-normalised shares over observed cells."""
    g = (pairs.select(align_bin("post_score").alias("post_cat"),
                      align_bin("avg_comment_score").alias("comment_cat"))
         .filter(F.col("post_cat").isNotNull() & F.col("comment_cat").isNotNull())
         .groupBy("post_cat", "comment_cat").agg(F.count(F.lit(1)).alias("n")))
    rows = g.groupBy("post_cat").agg(F.sum("n").alias("_row"))
    return g.join(rows, "post_cat").select("post_cat", "comment_cat", "n",
                                           (F.col("n") / F.col("_row")).alias("share"))


def post_label_maps(df: DataFrame, label: str, order_cols, post_col: str = "post_id",
                    comment_col: str = "comment_id") -> DataFrame:
    """F23 + H2: per post, the label -> count map of its rows (NULL labels left
    out), its comment count and the first label that is not NULL.

    Counts per (post, label) are reduced first, so the map for one post is
    built from at most one entry per label value.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    cells = df.groupBy(post_col, label).agg(F.count(F.lit(1)).alias("n"), F.count(comment_col).alias("_nc"),
                                            F.min(order).alias("_o"))
    known = F.col(label).isNotNull()
    # At most one cell per label value (and one for NULL) and post.
    pairs = F.array_sort(F.collect_list(F.when(known, F.struct(F.col(label), F.col("n")))))
    out = cells.groupBy(post_col).agg(
        F.sum("_nc").alias("n_comments"),
        F.min_by(F.col(label), F.when(known, F.col("_o"))).alias("post_label"),
        F.map_from_entries(pairs).alias("_m"))
    return out.select(post_col, "n_comments", "post_label", F.when(F.size("_m") > 0, F.col("_m")).alias("label_counts"))
