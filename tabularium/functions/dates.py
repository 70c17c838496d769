"""Calendar helpers on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_start(c) -> Column:
    return F.trunc(F.to_date(c), "month")


def month_label(c) -> Column:
    return F.date_format(c, "yyyy-MM")


def weekday_label(c) -> Column:
    return F.date_format(c, "EEE")


def weekday_number(c) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def seconds_between(start, end) -> Column:
    """Whole seconds from start to end, rounded down."""
    micros = F.unix_micros(F.col(end).cast("timestamp") if isinstance(end, str) else end.cast("timestamp")) - \
        F.unix_micros(F.col(start).cast("timestamp") if isinstance(start, str) else start.cast("timestamp"))
    return F.floor(micros / F.lit(1000000)).cast("bigint")
