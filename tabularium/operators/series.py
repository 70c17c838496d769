"""Daily and monthly series: sums per period, empty periods, growth and trend.

A series has one row per calendar period, so the windows below run over at most a few thousand rows per series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tabularium.functions.dates import month_start


def totals_by(df: DataFrame, moment: str, measure: str, unit: str = "month", by: list[str] | None = None) -> DataFrame:
    """``(by…, period, total)``; rows without a moment or a measure are left out."""
    period = month_start(moment) if unit == "month" else F.to_date(moment)
    return (df.filter(F.col(moment).isNotNull() & F.col(measure).isNotNull())
              .groupBy(*(by or []), period.alias("period")).agg(F.sum(measure).alias("total")))


def fill_gaps(series: DataFrame, unit: str = "month", by: list[str] | None = None) -> DataFrame:
    """Add the missing periods between the first and the last one with total 0.

    Each row expands up to the period before its successor, so no calendar table and no second scan are needed.
    """
    following = F.lead("period").over(W.partitionBy(*(by or [])).orderBy("period"))
    last = F.add_months(following, -1) if unit == "month" else F.date_sub(following, 1)
    step = F.expr("interval 1 month") if unit == "month" else F.expr("interval 1 day")
    spread = series.withColumn("_last", F.coalesce(last, F.col("period")))
    spread = spread.withColumn("_slot", F.explode(F.sequence("period", "_last", step)))
    return spread.select(*(by or []), F.col("_slot").alias("period"),
                         F.when(F.col("_slot") == F.col("period"), F.col("total")).otherwise(F.lit(0.0)).alias("total"))


def monthly(df: DataFrame, moment: str, measure: str, by: list[str] | None = None) -> DataFrame:
    return fill_gaps(totals_by(df, moment, measure, "month", by), "month", by)


def daily(df: DataFrame, moment: str, measure: str, by: list[str] | None = None) -> DataFrame:
    return fill_gaps(totals_by(df, moment, measure, "day", by), "day", by)


def last_change(months: DataFrame) -> DataFrame:
    """One row: last period, its total, the total before and the percent change (null if the latter is 0)."""
    before = F.lag("total").over(W.orderBy("period"))
    return (months.withColumn("previous", before).orderBy(F.desc("period")).limit(1)
            .filter(F.col("previous").isNotNull())
            .select("period", F.col("total").alias("last"), "previous",
                    F.try_divide((F.col("total") - F.col("previous")) * 100.0, "previous").alias("change_pct")))


def trend(months: DataFrame) -> DataFrame:
    """One row: periods, slope, intercept and r of total over the period number."""
    numbered = months.withColumn("x", (F.row_number().over(W.orderBy("period")) - 1).cast("double"))
    return numbered.agg(F.count(F.lit(1)).alias("periods"), F.regr_slope("total", "x").alias("slope"),
                        F.regr_intercept("total", "x").alias("intercept"), F.corr("total", "x").alias("r"))


def running_total(months: DataFrame) -> DataFrame:
    over = W.orderBy("period").rowsBetween(W.unboundedPreceding, W.currentRow)
    return months.withColumn("running", F.sum("total").over(over))
