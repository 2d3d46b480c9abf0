"""Findings records (L3, L4, C12): computed numbers rendered as report rows.

Each finding is one row of a small aggregate frame (topic changes, trend
fits, correlations, extremes), so the findings table is a ``unionByName`` of
tiny frames; rounding happens before formatting so both engines print the
same digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_COLS = ["question", "metric", "subject", "value", "text"]


def _pct(x, digits: int = 1):
    return F.format_string(f"%.{digits}f%%", F.round(x * 100, digits))


def _spct(x, digits: int = 1):
    return F.format_string(f"%+.{digits}f%%", F.round(x * 100, digits))


def _fix(x, digits: int):
    return F.format_string(f"%.{digits}f", F.round(x, digits))


def prevalence_findings(gain_loss: DataFrame) -> DataFrame:
    """RQ1: top gaining / losing topics with signed percentage-point changes."""
    return gain_loss.select(
        F.lit("topic_prevalence").alias("question"), F.col("side").alias("metric"),
        F.concat(F.lit("topic "), F.col("topic").cast("string")).alias("subject"),
        F.col("change").cast("double").alias("value"),
        F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(": "), _spct(F.col("change"))).alias("text"))


def contagion_findings(corr: DataFrame) -> DataFrame:
    """RQ2: post -> comment correlation, strength and slope."""
    return corr.select(
        F.lit("post_comment").alias("question"), F.lit("pearson_r").alias("metric"),
        F.col("strength").alias("subject"), F.col("r").cast("double").alias("value"),
        F.concat(F.lit("r = "), _fix(F.col("r"), 3), F.lit(", slope = "), _fix(F.col("slope"), 4),
                 F.lit(" ("), F.col("strength"), F.lit(" "), F.col("direction"), F.lit(")")).alias("text"))


def risk_findings(top_topics: DataFrame) -> DataFrame:
    """RQ3: most negative topics with share and row count (thousands separators)."""
    return top_topics.select(
        F.lit("high_risk").alias("question"), F.concat(F.lit("top_negative_"), F.col("model")).alias("metric"),
        F.concat(F.lit("topic "), F.col("topic").cast("string")).alias("subject"),
        F.col("neg_pct").cast("double").alias("value"),
        F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(": "), _pct(F.col("neg_pct")),
                 F.lit(" of "), F.format_number(F.col("n_rows"), 0)).alias("text"))


def trend_findings(trends: DataFrame, model: str) -> DataFrame:
    """F29 rendered: start -> end share, slope per year and R^2 per label."""
    return trends.select(
        F.lit("sentiment_trend").alias("question"), F.concat(F.lit(model + "_"), F.col("label")).alias("metric"),
        F.col("direction").alias("subject"), F.col("slope").cast("double").alias("value"),
        F.concat(_pct(F.col("start")), F.lit(" to "), _pct(F.col("end")), F.lit(", slope "),
                 _fix(F.col("slope"), 4), F.lit("/yr, R2 "), _fix(F.col("r_squared"), 3)).alias("text"))


def number_rows(df: DataFrame, question: str, model: str, subject, values: dict[str, str]) -> list[DataFrame]:
    """L3 in long form: for each (metric -> column) a frame ``question, model, metric, subject, value``."""
    return [df.select(F.lit(question).alias("question"), F.lit(model).alias("model"), F.lit(metric).alias("metric"),
                      subject.alias("subject"), F.col(f"`{column}`").cast("double").alias("value"))
            for metric, column in values.items()]


def findings_table(*parts: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        p = p.select(*SCHEMA_COLS)
        out = p if out is None else out.unionByName(p)
    return out
