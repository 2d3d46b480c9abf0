"""Sentiment label scalars (D3, D5, D7) and key helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three sentiment classes in report order.
LABELS = ["negative", "neutral", "positive"]
# Default compound cut-offs of the lexicon model.
POS_THRESHOLD = 0.05
NEG_THRESHOLD = -0.05


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compound_label(compound, pos: float = POS_THRESHOLD, neg: float = NEG_THRESHOLD) -> Column:
    """D3: >= pos -> positive, <= neg -> negative, otherwise (and NULL) neutral."""
    c = _c(compound)
    return F.when(c >= pos, "positive").when(c <= neg, "negative").otherwise("neutral")


def normalize_model_label(label) -> Column:
    """Map free-form model labels onto the three classes.

    Substring tests in order neg, pos, neu; then LABEL_0/1/2; otherwise the
    lower-cased input. NULL stays NULL.
    """
    s = F.lower(_c(label).cast("string"))
    return (F.when(s.contains("neg"), "negative")
            .when(s.contains("pos"), "positive")
            .when(s.contains("neu"), "neutral")
            .when(s.contains("label_0"), "negative")
            .when(s.contains("label_1"), "neutral")
            .when(s.contains("label_2"), "positive")
            .otherwise(s))


def polarity(label) -> Column:
    """Positive -> 1, negative -> -1, anything else (incl. NULL) -> 0."""
    l = _c(label)
    return F.coalesce((l == "positive").cast("int") - (l == "negative").cast("int"), F.lit(0))


def is_label(label, value: str) -> Column:
    """1.0 when ``label == value``; NULL label counts as 0.0 (mean-of-boolean semantics)."""
    return F.coalesce((_c(label) == value).cast("double"), F.lit(0.0))


def topic_subtopic_key(topic, subtopic) -> Column:
    """Composite label ``T{topic}-S{subtopic}``."""
    return F.format_string("T%d-S%d", _c(topic).cast("int"), _c(subtopic).cast("int"))


def null_bucket(key, bucket: str = "None") -> Column:
    """NULL key -> explicit string bucket (``None`` for topics, ``UNKNOWN`` for users)."""
    return F.coalesce(_c(key).cast("string"), F.lit(bucket))
