"""Trends over time.

Inputs are the small period tables produced by the distribution operators,
so every statistic is one more aggregate over at most (periods x labels)
rows; first/last periods come from ``min_by``/``max_by``, never a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import LABELS
from ..functions.stats import pearson_p_col


def label_trends(yearly: DataFrame, year_col: str = "year", labels=LABELS) -> DataFrame:
    """per label, least-squares trend of its yearly share.

    slope, r_squared (= r^2, 0 for a constant series), two-sided p, direction
    (slope > 0 -> increasing, else decreasing), start/end share (first/last
    year) and change. Needs more than one year; otherwise no rows.
    """
    parts = F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).cast("double").alias("share")) for l in labels])
    long = yearly.select(F.col(year_col).cast("double").alias("x"), F.explode(parts).alias("p")) \
                 .select("x", "p.label", "p.share")
    g = long.groupBy("label").agg(
        F.regr_slope("share", "x").alias("slope"),
        F.corr("x", "share").alias("r"),
        F.var_samp("share").alias("_vy"),
        F.count(F.lit(1)).alias("n_years"),
        F.min_by("share", "x").alias("start"),
        F.max_by("share", "x").alias("end"))
    r2 = F.when(F.col("_vy") == 0, F.lit(0.0)).otherwise(F.col("r") * F.col("r"))
    return (g.filter(F.col("n_years") > 1).select(
        "label", "slope", r2.alias("r_squared"),
        pearson_p_col(F.when(F.col("_vy") == 0, F.lit(0.0)).otherwise(F.col("r")), F.col("n_years")).alias("p_value"),
        F.when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("direction"),
        "start", "end", (F.col("end") - F.col("start")).alias("change"), "n_years"))


def topic_change(topic_year: DataFrame, year_col: str = "year", topic_col: str = "topic",
                 share_col: str = "share") -> DataFrame:
    """Share in the last year minus share in the first year, per topic.

    Input is the long (year, topic, share) table; a topic absent in a year has
    share 0 there (dense grid). Empty when the table spans a single year.
    """
    # The window runs over the aggregated (year, topic) table, so the facts are read once.
    whole = Window.partitionBy(F.lit(0))
    t = topic_year.withColumn("_first", F.min(year_col).over(whole)).withColumn("_last", F.max(year_col).over(whole))
    g = t.groupBy(topic_col).agg(
        F.coalesce(F.sum(F.when(F.col(year_col) == F.col("_first"), F.col(share_col))), F.lit(0.0)).alias("first_share"),
        F.coalesce(F.sum(F.when(F.col(year_col) == F.col("_last"), F.col(share_col))), F.lit(0.0)).alias("last_share"),
        F.first("_first").alias("first_year"), F.first("_last").alias("last_year"))
    return (g.filter(F.col("last_year") > F.col("first_year"))
            .select(topic_col, "first_year", "last_year", "first_share", "last_share",
                    (F.col("last_share") - F.col("first_share")).alias("change")))


def gain_loss_top(changes: DataFrame, n: int = 3, topic_col: str = "topic") -> DataFrame:
    """Top-n gaining (head of the descending order) and the last n of the same
    order (losing). With fewer than 2n topics the two lists overlap, as in the reference."""
    whole = Window.partitionBy(F.lit(0))  # one row per topic
    up = F.row_number().over(whole.orderBy(F.desc("change"), F.asc(topic_col)))
    down = F.row_number().over(whole.orderBy(F.asc("change"), F.desc(topic_col)))
    sides = F.array(F.when(F.col("_up") <= n, F.lit("gaining")), F.when(F.col("_down") <= n, F.lit("losing")))
    return (changes.withColumn("_up", up).withColumn("_down", down)
            .select(F.explode(F.array_compact(sides)).alias("side"), topic_col, "change", "_up", "_down")
            .orderBy("side", F.when(F.col("side") == "gaining", F.col("_up")).otherwise(F.col("_down")))
            .drop("_up", "_down"))
