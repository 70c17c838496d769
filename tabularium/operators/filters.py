"""Row filters built from what a grid, chart or log request carries. Unset parts filter nothing."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabularium.functions import parsing
from tabularium.operators import stats


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def one_of(column: str, values: list, df: DataFrame | None = None) -> Column:
    """Text equality with any of ``values``; an empty list keeps everything.

    With the frame given, a whole-number column is compared as numbers, which is the same rows and reaches the scan.
    """
    if not values:
        return F.lit(True)
    texts = [str(v) for v in values]
    if df is not None and isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        whole = [int(v) for v in texts if v.lstrip("-").isdigit() and str(int(v)) == v]
        return F.col(f"`{column}`").isin(whole)
    return F.col(f"`{column}`").cast("string").isin(texts)


def in_range(df: DataFrame, column: str, low=None, high=None) -> Column:
    """Inclusive range; a missing bound is open, text that is no number fails."""
    c = F.col(f"`{column}`")
    value = c if column in stats.numeric_columns(df) else parsing.to_number(c.cast("string"))
    parts = [value.isNotNull()] if low is not None or high is not None else []
    if low is not None:
        parts.append(value >= F.lit(low))
    if high is not None:
        parts.append(value <= F.lit(high))
    return _all(parts)


def matching(df: DataFrame, wanted: dict) -> DataFrame:
    """``wanted``: column -> list of values or {"min", "max"}. Unknown columns are ignored."""
    parts = []
    for column, rule in wanted.items():
        if column not in df.columns:
            continue
        if isinstance(rule, dict):
            parts.append(in_range(df, column, rule.get("min"), rule.get("max")))
        else:
            parts.append(one_of(column, list(rule), df))
    return df.filter(_all(parts))


def containing(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Case-insensitive substring in any of the columns (default: all)."""
    if not text:
        return df
    needle = F.lit(text.lower())
    hits = [F.coalesce(F.contains(F.lower(F.col(f"`{c}`").cast("string")), needle), F.lit(False))
            for c in columns or df.columns]
    return df.filter(reduce(or_, hits))


def optional(df: DataFrame, equal: dict | None = None, contains: dict | None = None, moment: str | None = None,
             start=None, end=None) -> DataFrame:
    """Conjunction of the parts that are set: equality, substring, and a closed time range."""
    parts = [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if v is not None]
    parts += [F.contains(F.lower(c), F.lit(v.lower())) for c, v in (contains or {}).items() if v]
    if moment and start is not None:
        parts.append(F.col(moment) >= F.lit(start).cast("timestamp_ntz"))
    if moment and end is not None:
        parts.append(F.col(moment) <= F.lit(end).cast("timestamp_ntz"))
    return df.filter(_all(parts))


def last_days(df: DataFrame, moment: str, days: int) -> Column:
    """Rows of the last ``days`` calendar days before and including the newest row's day."""
    if days < 1:
        raise ValueError("days must be at least 1")
    newest = df.agg(F.max(F.to_date(moment))).scalar()
    return F.to_date(moment) >= F.date_sub(newest, days - 1)


def sparse_rows_dropped(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Drop footer-like rows: more than ``share`` of the cells are null."""
    empty = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0))
    return df.filter(empty / F.lit(len(df.columns)) <= F.lit(share))


# Index columns a spreadsheet export leaves behind.
INDEX_COLUMNS = ("Unnamed: 0", "Unnamed: 0.1")


def visible(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    kept = [c for c in df.columns if c not in INDEX_COLUMNS and (columns is None or c in columns)]
    return df.select(*[F.col(f"`{c}`") for c in kept])
