"""Column-role resolution (plan-time only, never runs a job).

Discussion tables in the wild name the same role differently; operators
look a role up through an ordered candidate list and fail early with a
clear message when a required role is absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Candidate names per role, in priority order.
TIME_CANDIDATES = ["comment_created_utc", "post_created_utc", "created_utc", "created", "timestamp"]
TOPIC_CANDIDATES = ["topic_id", "main_topic", "topic"]
SUBTOPIC_CANDIDATES = ["comment_subtopic", "subtopic", "comment_subtopic_id"]
TEXT_CANDIDATES = ["sentiment_text", "comment_text_clean", "comment_text_lem", "post_text_clean",
                   "post_text_lem", "text_clean", "text_lem"]
USER_CANDIDATES = ["author", "username", "user", "user_name"]
POST_KEY_CANDIDATES = ["post_id", "postId", "id"]
POST_TEXT_CANDIDATES = ["post_text_clean", "post_text_lem", "post_title", "post_body"]
COMMENT_TEXT_CANDIDATES = ["comment_text_clean", "comment_text_lem", "comment_body", "comment"]
LEXICON_LABEL_CANDIDATES = ["vader_label", "vader_sentiment", "vader_polarity"]
MODEL_LABEL_CANDIDATES = ["bert_label", "hf_label", "bert_sentiment"]


def first_existing(df: DataFrame, names) -> str | None:
    """First column of ``names`` present in ``df`` (None when none is)."""
    cols = set(df.columns)
    return next((c for c in names if c in cols), None)


def require_columns(df: DataFrame, names) -> None:
    """Raise ``ValueError`` listing every required column that is missing."""
    missing = [c for c in names if c not in set(df.columns)]
    if missing:
        raise ValueError(f"missing required column(s): {missing}; have {df.columns}")


def require_one(df: DataFrame, names, role: str) -> str:
    """Resolve a role or raise ``ValueError`` naming the candidates tried."""
    c = first_existing(df, names)
    if c is None:
        raise ValueError(f"no {role} column found; tried {list(names)}")
    return c


def with_default(df: DataFrame, name: str, default, fallbacks=()) -> DataFrame:
    """Ensure ``name`` exists: take the first fallback column, else a literal.

    E.g. ``comment_subtopic`` defaults to -1, ``topic_id`` falls back to
    ``topic``, ``comment_text_lem`` to ``comment_body``.
    """
    if name in df.columns:
        return df
    src = first_existing(df, fallbacks)
    return df.withColumn(name, F.col(src) if src else F.lit(default))
