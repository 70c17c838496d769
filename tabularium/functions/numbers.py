"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r4(c: Column) -> Column:
    """Four decimals, with negative zero turned into zero."""
    return F.round(c, 4) + F.lit(0.0)


def display2(c: Column) -> Column:
    """Two decimals for display, halves up; the inner rounding removes summation noise first."""
    return F.floor(F.round(c, 4) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def display2_sql(expr: str) -> str:
    """The same rounding as :func:`display2` in SQL text."""
    return f"(floor(round({expr}, 4) * 100.0 + 0.5) / 100.0)"


def clip(c: Column, low, high) -> Column:
    """Clip to [low, high]; null stays null (``greatest``/``least`` would replace it)."""
    return F.when(c < low, low).when(c > high, high).otherwise(c)
