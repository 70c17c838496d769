"""Cleaning steps: null filling, duplicates, casts and outliers. Each step is DataFrame in, DataFrame out.

Statistics enter a plan either as a scalar subquery (mean, mode) or as a few literals from one aggregate job
(quantiles, null shares), so the rows themselves are never shuffled to fill or clip a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabularium.functions import numbers, parsing
from tabularium.operators import stats


# ---- nulls ---------------------------------------------------------------------------------------------

def fill(df: DataFrame, column: str, how: str, placeholder: str = "") -> DataFrame:
    """``how``: zero, mean, median, mode, drop, empty (placeholder text). Mean and median leave text alone."""
    c = F.col(f"`{column}`")
    numeric = column in stats.numeric_columns(df)
    if how == "drop":
        return df.na.drop(subset=[column])
    if how == "zero":
        value = F.lit(0).cast(df.schema[column].dataType) if numeric else F.lit("0")
    elif how == "mean":
        value = df.agg(F.avg(c)).scalar() if numeric else None
    elif how == "median":
        value = F.lit(stats.quantiles(df, [column], [0.5])[column][0]) if numeric else None
    elif how == "mode":
        value = stats.mode_of(df, column)
    elif how == "empty":
        value, c = F.lit(placeholder), c.cast("string")
    else:
        raise ValueError(f"unknown fill: {how}")
    return df if value is None else df.withColumn(column, F.coalesce(c, value))


# The null policy's limit and the words it records.
DROP_SHARE = 0.70
DROPPED, BY_MEDIAN, BY_MODE = "dropped_column (>70% missing)", "Fill with median", "Fill with mode"


def null_decisions(df: DataFrame) -> DataFrame:
    """``(column_name, decision)`` the automatic policy would take; untouched columns have no row."""
    numeric, text = stats.numeric_columns(df), stats.string_columns(df)
    share = F.col("null_count") / F.col("total_rows")
    return (stats.null_counts(df)
            .withColumn("decision",
                        F.when(share > DROP_SHARE, DROPPED)
                        .when((F.col("null_count") > 0) & F.col("column_name").isin(numeric), BY_MEDIAN)
                        .when((F.col("null_count") > 0) & F.col("column_name").isin(text), BY_MODE))
            .filter(F.col("decision").isNotNull()).select("column_name", "decision"))


def auto_fill(df: DataFrame, **kw) -> tuple[DataFrame, dict[str, str]]:
    """Apply :func:`null_decisions`: drop mostly empty columns, median for numbers, mode for text; ``kw`` as in quantiles."""
    chosen = {r["column_name"]: r["decision"] for r in null_decisions(df).collect()}  # one row per column
    out = df.drop(*[c for c, d in chosen.items() if d == DROPPED])
    by_median = [c for c, d in chosen.items() if d == BY_MEDIAN]
    middle = stats.quantiles(df, by_median, [0.5], **kw)
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(middle[c][0])) for c in by_median}
    by_mode = [c for c, d in chosen.items() if d == BY_MODE]
    if by_mode:
        common = {r["column_name"]: r["mode"] for r in stats.modes(df, by_mode).collect()}  # one row per column
        filled |= {c: F.coalesce(F.col(f"`{c}`"), F.lit(common[c])) for c in by_mode if c in common}
    return out.withColumns(filled) if filled else out, chosen


def drop_sparse_columns(df: DataFrame, share: float = DROP_SHARE) -> DataFrame:
    sparse = [r["column_name"] for r in stats.null_counts(df)
              .filter(F.col("null_count") / F.col("total_rows") > share).collect()]
    return df.drop(*sparse)


def columns_with_nulls(df: DataFrame) -> list[str]:
    rows = stats.null_counts(df).filter(F.col("null_count") > 0).collect()
    return [r["column_name"] for r in sorted(rows, key=lambda r: r["position"])]


# ---- duplicates ----------------------------------------------------------------------------------------

def dedup(df: DataFrame, keep: str = "first", keys: list[str] | None = None, order: list | None = None) -> DataFrame:
    """``keep``: first, last or none. Over all columns first and last are the same rows.

    For a key subset the kept row is the extreme one by ``order``; it is found with a partial aggregate
    (``min_by``/``max_by`` on a struct), so many copies of one key never meet in one sort.
    """
    if keys is None:
        if keep == "none":
            return (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
                      .filter("_copies = 1").drop("_copies"))
        return df.distinct()
    rest = [c for c in df.columns if c not in keys]
    if keep == "none":
        once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), F.min(F.struct(*rest)).alias("_row"))
        return once.filter("_copies = 1").select(*[F.col(k) for k in keys], "_row.*").select(*df.columns)
    pick = F.min_by if keep == "first" else F.max_by
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return one.select(*[F.col(k) for k in keys], "_row.*").select(*df.columns)


# ---- types ---------------------------------------------------------------------------------------------

def cast_column(c: Column, target: str) -> Column:
    """Integer and Float turn unreadable text into 0; Boolean and Date into null."""
    if target == "Integer":
        return F.coalesce(parsing.to_number(c.cast("string")), F.lit(0.0)).cast("bigint")
    if target == "Float":
        return F.coalesce(parsing.to_number(c.cast("string")), F.lit(0.0))
    if target == "String":
        return c.cast("string")
    if target == "Boolean":
        return parsing.to_boolean(c)
    if target == "Date":
        return parsing.to_datetime(c.cast("string"))
    raise ValueError(f"unknown target type: {target}")


def cast_columns(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    return df.withColumns({c: cast_column(F.col(f"`{c}`"), t) for c, t in targets.items() if c in df.columns})


# Share of readable values from which a text column is converted.
NUMBER_SHARE, DATE_SHARE = 0.85, 0.75


def cast_decisions(df: DataFrame) -> dict[str, str]:
    """Text columns that read as numbers or dates."""
    chosen = {}
    for part in stats.in_batches(stats.string_columns(df)):
        shares = df.agg(*[F.try_divide(F.count_if(test(F.col(f"`{c}`"))), F.count(F.col(f"`{c}`")))
                          for c in part for test in (parsing.is_number, lambda x: parsing.to_datetime(x).isNotNull())]).first()
        for i, c in enumerate(part):
            if (shares[2 * i] or 0) >= NUMBER_SHARE:
                chosen[c] = "Float"
            elif (shares[2 * i + 1] or 0) >= DATE_SHARE:
                chosen[c] = "Date"
    return chosen


def auto_cast(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Convert by :func:`cast_decisions`; unreadable values become null."""
    chosen = cast_decisions(df)
    convert = {"Float": parsing.to_number, "Date": parsing.to_datetime}
    return df.withColumns({c: convert[t](F.col(f"`{c}`")) for c, t in chosen.items()}) if chosen else df, chosen


# ---- outliers ------------------------------------------------------------------------------------------

def outliers(df: DataFrame, column: str, how: str) -> DataFrame:
    """``how``: remove, iqr (cap at the fences) or zscore (cap at mean ± 3 standard deviations)."""
    c = F.col(f"`{column}`")
    if how in ("remove", "iqr"):
        bounds = stats.iqr_bounds(df, [column])
        if column not in bounds:
            return df.filter(F.lit(False)) if how == "remove" else df
        low, high = bounds[column]
        return df.filter(c.between(low, high)) if how == "remove" \
            else df.withColumn(column, numbers.clip(c, F.lit(low), F.lit(high)))
    if how == "zscore":
        s = df.agg(F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))).scalar()
        low, high = s["mean"] - 3 * s["std"], s["mean"] + 3 * s["std"]
        return df.withColumn(column, F.when(s["std"] > 0, numbers.clip(c, low, high)).otherwise(c))
    raise ValueError(f"unknown outlier rule: {how}")


def outliers_in_turn(df: DataFrame, steps: dict[str, str]) -> DataFrame:
    """Manual steps one after the other: a removal changes the fences of the next column."""
    for column, how in steps.items():
        df = outliers(df, column, how)
    return df


def auto_cap(df: DataFrame, **kw) -> tuple[DataFrame, dict[str, str]]:
    """Cap every numeric column that has an outlier; fences and counts cost two aggregates over all columns."""
    found = {r["column_name"]: r for r in stats.outlier_cells(df, **kw).filter("outliers > 0").collect()}
    capped = {c: numbers.clip(F.col(f"`{c}`").cast("double"), F.lit(r["lower_bound"]), F.lit(r["upper_bound"]))
              for c, r in found.items()}
    return df.withColumns(capped) if capped else df, {c: "IQR capping" for c in found}


# ---- text ----------------------------------------------------------------------------------------------

def tidy_text(c: Column, *ops: str) -> Column:
    """``ops`` in order: trim, title, remove_special."""
    for op in ops:
        if op == "trim":
            c = F.trim(c)
        elif op == "title":
            c = F.initcap(F.lower(c))
        elif op == "remove_special":
            c = F.regexp_replace(c, r"[^A-Za-z0-9 ]", "")
        else:
            raise ValueError(f"unknown text operation: {op}")
    return c
