"""Registered queries: each binds the given tables to roles, runs operators,
and carries the equivalent DuckDB SQL used as its correctness oracle."""

from .registry import oracle_sql, queries  # noqa: F401
from . import aggregates, coherence_fixed, extras, given_models, models, roles, tagging, textual, topic_view  # noqa: F401  (registers queries on import)
