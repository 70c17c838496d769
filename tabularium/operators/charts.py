"""Chart data: grouped aggregates, shares, time series and the dashboard frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabularium.functions.numbers import display2
from tabularium.operators import filters, series, stats

_MEASURES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}


def label(c: Column, size: int = 18) -> Column:
    """Axis label: missing or empty becomes Unknown, long text is cut for display after grouping."""
    return F.substring(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("Unknown")), 1, size)


def shortened(data: DataFrame, column: str, size: int, within: list[str] = ()) -> DataFrame:
    """Names cut for display, but whole where two groups of a chart would otherwise show the same name."""
    full = F.col(column).cast("string")
    cut = F.substring(full, 1, size)
    alone = F.count(F.lit(1)).over(W.partitionBy(*within, cut)) == 1
    return data.withColumn(column, F.when(alone, cut).otherwise(full))


def aggregate(df: DataFrame, x: str, y: str | None, how: str, wanted: dict | None = None, limit: int | None = 10) -> DataFrame:
    """``(name, value, n)``: ``how`` of y per x after the filters, two decimals, largest first, top ``limit``."""
    key = F.coalesce(F.nullif(F.col(x).cast("string"), F.lit("")), F.lit("Unknown"))
    value = F.count(F.lit(1)).cast("double") if how == "count" else _MEASURES[how](F.col(y))
    grouped = filters.matching(df, wanted or {}).groupBy(key.alias("name")).agg(
        display2(value).alias("value"), F.count(F.lit(1)).alias("n"))
    ranked = grouped.orderBy(F.desc("value"), "name")
    ranked = ranked.limit(limit) if limit else ranked
    return shortened(ranked, "name", 18).select("name", "value", "n")


def share(df: DataFrame, x: str, y: str, top: int = 8) -> DataFrame:
    """``(name, value, pct)`` of the largest positive groups, percent of the total over all groups; at least two."""
    key = F.coalesce(F.nullif(F.col(x).cast("string"), F.lit("")), F.lit("Unknown"))
    groups = df.groupBy(key.alias("name")).agg(F.sum(y).alias("value")).filter(F.col("value").isNotNull())
    one = groups.agg(F.struct(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("positive"))).scalar()
    return (groups.filter((F.col("value") > 0) & (one["positive"] >= 2))
                  .withColumn("pct", F.round(F.col("value") * 100.0 / one["total"], 1))
                  .orderBy(F.desc("value"), "name").limit(top)
                  .withColumn("value", display2(F.col("value"))))


def footer(data: DataFrame) -> DataFrame:
    """One row under a chart: sum of the values, number of records and the average per record."""
    return data.agg(F.sum("value").alias("total"), F.sum("n").alias("records")).withColumn(
        "average", F.coalesce(F.try_divide("total", "records"), F.lit(0.0)))


def top(df: DataFrame, x: str, y: str, n: int = 10) -> DataFrame:
    """``(x, y)``: groups with the largest sum of y; rows without x are left out."""
    best = (df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("x"))
              .agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("y")).orderBy(F.desc("y"), "x").limit(n))
    return shortened(best, "x", 20).select("x", "y")


def time_series(df: DataFrame, moment: str, y: str, points: int = 30, many: bool | None = None) -> DataFrame:
    """``(x, y)``: the last points; raw rows when there are no more than ``points``, else months with data.

    Whether there are more is looked up with a small limit, which is cheap on a scan; for a frame behind joins or
    groupings the caller can say so with ``many``.
    """
    rows = df.filter(F.col(moment).isNotNull() & F.col(y).isNotNull())
    if many is None:
        many = rows.limit(points + 1).count() > points
    if not many:
        return rows.select(F.col(moment).cast("string").alias("x"), F.col(y).alias("y")).orderBy("x")
    months = series.totals_by(rows, moment, y).select(F.date_format("period", "yyyy-MM").alias("x"), F.col("total").alias("y"))
    return months.orderBy(F.desc("x")).limit(points).orderBy("x")


def first_category(nunique: DataFrame, columns: list[str], below: int, at_least: int = 1) -> str | None:
    """First column, in the given order, whose distinct count lies in [at_least, below)."""
    counts = {r["column_name"]: r["nunique"] for r in nunique.collect()}  # one row per column
    return next((c for c in columns if at_least <= counts.get(c, 0) < below), None)


def as_rows(data: DataFrame, chart_id: str, kind: str, by: str = "y") -> DataFrame:
    """Dashboard rows ``(chart_id, chart_type, rank, x, y)`` of one chart (a chart has at most 30 points)."""
    order = W.orderBy(F.desc("y"), "x") if by == "y" else W.orderBy("x")
    return data.select(F.lit(chart_id).alias("chart_id"), F.lit(kind).alias("chart_type"),
                       F.row_number().over(order).alias("rank"), "x", F.round("y", 4).alias("y"))


def all_categories(df: DataFrame, category: str, measures: list[str], n: int = 10) -> DataFrame:
    """``(measure, x, y)``: top groups of one category for many measures from a single aggregate."""
    one = df.filter(F.col(category).isNotNull()).groupBy(F.col(category).alias("x")).agg(
        *[F.coalesce(F.sum(F.col(m).cast("double")), F.lit(0.0)).alias(m) for m in measures])
    long = one.unpivot(["x"], measures, "measure", "y")
    place = F.row_number().over(W.partitionBy("measure").orderBy(F.desc("y"), "x"))
    best = long.withColumn("rank", place).filter(F.col("rank") <= n)
    return shortened(best, "x", 20, ["measure"]).select("measure", "rank", "x", "y")


def importance_bar(importance: DataFrame, n: int = 10) -> DataFrame:
    """``(x, y)`` from ``(feature, importance)`` rows."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n).select(
        F.col("feature").alias("x"), F.round("importance", 4).alias("y"))


# Distinct counts below which a text column serves as a category, by chart, and the chart counts.
CUSTOMER_BELOW, QUANTITY_BELOW, SECOND_BELOW, EXTRA_BELOW = 30, 20, 15, 20
FEW_CHARTS, MOST_CHARTS = 6, 7


def dashboard(df: DataFrame, roles: dict[str, str], importance: DataFrame | None = None) -> DataFrame:
    """Dashboard rows for a table with the given role columns; missing roles fall back to short text columns."""
    date, sales, product = roles.get("date"), roles.get("sales"), roles.get("product")
    region, customer, quantity, profit = (roles.get(r) for r in ("region", "customer", "quantity", "profit"))
    texts, numeric = stats.string_columns(df), stats.numeric_columns(df)
    counts = {r["column_name"]: r["nunique"] for r in stats.nunique(df, texts).collect()} if texts else {}  # one row per column

    def category(below: int, skip: tuple = ()) -> str | None:
        return next((c for c in texts if c not in skip and 0 < counts.get(c, 0) < below), None)

    boards: list[tuple[DataFrame, str, str, str]] = []
    months = time_series(df, date, sales) if date and sales else None
    if months is not None:
        boards.append((months, "trend_line", "line", "x"))
    if product and sales:
        boards.append((top(df, product, sales), "product_bar", "bar", "y"))
    if region and sales:
        boards.append((top(df, region, sales), "region_pie", "pie", "y"))
    if months is not None:
        boards.append((months, "revenue_area", "area", "x"))
    buyer = customer or category(CUSTOMER_BELOW, (product, region, date))
    if buyer and sales:
        boards.append((top(df, buyer, sales, 8), "customer_bar", "bar", "y"))
    sold_by = product or category(QUANTITY_BELOW)
    if quantity and sold_by:
        boards.append((top(df, sold_by, quantity), "qty_bar", "bar", "y"))
    second = next((c for c in numeric if c != sales), None)
    if importance is not None:
        boards.append((importance_bar(importance), "feature_importance_bar", "bar", "y"))
    elif profit and date:
        boards.append((time_series(df, date, profit), "profit_trend", "area", "x"))
    elif sales and second and category(SECOND_BELOW):
        boards.append((top(df, category(SECOND_BELOW), second), "secondary_metric_bar", "bar", "y"))
    if len(boards) < FEW_CHARTS and sales in numeric and category(EXTRA_BELOW, (date,)):
        for extra in [c for c in numeric if c != sales][:MOST_CHARTS - len(boards)]:
            boards.append((top(df, category(EXTRA_BELOW, (date,)), extra), f"extra_{extra}", "bar", "y"))
    out = None
    for data, chart_id, kind, by in boards:
        rows = as_rows(data.withColumn("y", F.round(F.col("y").cast("double"), 4)), chart_id, kind, by)
        out = rows if out is None else out.unionByName(rows)
    return out
