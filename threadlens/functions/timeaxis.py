"""Time scalars (K1-K3): coerce, year, month start. Session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def coerce_time(df: DataFrame, col: str) -> Column:
    """K1: numeric -> unix seconds, string -> parsed timestamp, bad -> NULL.

    The unit is decided by the column type (plan time), not by sniffing the
    first value.
    """
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(dt, T.DateType):
        return c.cast("timestamp")
    if isinstance(dt, T.NumericType):
        return F.timestamp_seconds(c.cast("double"))
    return F.try_to_timestamp(c.cast("string"))


def year_of(t: Column) -> Column:
    """K2: calendar year (int)."""
    return F.year(t)


def month_start(t: Column) -> Column:
    """K3: first day of the month, as a date."""
    return F.to_date(F.date_trunc("month", t))


def period_key(t: Column, period: str) -> Column:
    if period == "year":
        return year_of(t)
    if period == "month":
        return month_start(t)
    if period == "day":
        return F.to_date(t)
    raise ValueError(f"unknown period {period!r}")
