"""Business figures: totals, best and worst groups, profitability, period comparison and its drivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def group_totals(df: DataFrame, key: str, measure: str) -> DataFrame:
    """``(key, total)``; rows without a key are left out, an all-null group counts as 0."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias("total")))


def summary(df: DataFrame, sales: str, profit: str | None = None) -> DataFrame:
    """One row: total sales, average order value, total profit and margin percent (only for positive sales)."""
    one = df.agg(F.coalesce(F.sum(sales), F.lit(0.0)).alias("total_sales"), F.avg(sales).alias("average_order_value"),
                 *([F.coalesce(F.sum(profit), F.lit(0.0)).alias("total_profit")] if profit else []))
    if profit:
        one = one.withColumn("profit_margin_percentage", F.when(
            F.col("total_sales") > 0, F.col("total_profit") / F.col("total_sales") * 100.0))
    return one


def best_and_worst(totals: DataFrame, key: str) -> DataFrame:
    """One row with the groups of the largest and smallest total; on ties the smaller key."""
    high, low = F.struct(-F.col("total"), F.col(key)), F.struct(F.col("total"), F.col(key))
    return totals.agg(F.min_by(key, high).alias("best"), F.max("total").alias("best_total"),
                      F.min_by(key, low).alias("worst"), F.min("total").alias("worst_total"))


def loss_makers(totals: DataFrame, key: str) -> DataFrame:
    """Groups with a negative total, the largest loss first."""
    return (totals.filter("total < 0").orderBy("total", key)
                  .select(key, F.abs("total").alias("loss")))


def winners(totals: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n largest positive totals, ascending."""
    return totals.filter("total > 0").orderBy(F.desc("total"), F.desc(key)).limit(n).orderBy("total", key)


def halves(df: DataFrame, second: Column) -> DataFrame:
    """Mark each row with period 1 or 2; ``second`` comes from :func:`ordering.split_after`."""
    return df.withColumn("period", F.when(second, F.lit(2)).otherwise(F.lit(1)))


def _sum_in(period: int, measure: str) -> Column:
    return F.sum(F.when(F.col("period") == period, F.col(measure)))


def compare_periods(marked: DataFrame, measure: str) -> DataFrame:
    """One row: both totals, change, direction and percent change (0 without a positive first total)."""
    both = marked.agg(F.count(F.lit(1)).alias("n"),
                      F.coalesce(_sum_in(1, measure), F.lit(0.0)).alias("first_total"),
                      F.coalesce(_sum_in(2, measure), F.lit(0.0)).alias("second_total"))
    delta = F.col("second_total") - F.col("first_total")
    return (both.filter("n >= 4").drop("n")
            .withColumn("delta", delta)
            .withColumn("direction", F.when(F.col("delta") > 0, "increased").otherwise("decreased"))
            .withColumn("change_pct", F.when(F.col("first_total") > 0,
                                             F.col("delta") / F.col("first_total") * 100.0).otherwise(F.lit(0.0))))


def period_sums(marked: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """``(keys, first, second, in1, in2)``: sums and row counts of both periods per key, which can be summed up further."""
    return marked.groupBy(*keys).agg(_sum_in(1, measure).alias("first"), _sum_in(2, measure).alias("second"),
                                     F.count_if(F.col("period") == 1).alias("in1"), F.count_if(F.col("period") == 2).alias("in2"))


def sums_by(sums: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value, first, second, in1, in2)``: period sums per value of each category column."""
    parts = ("first", "second", "in1", "in2")
    return (sums.select(*[F.col(c).cast("string").alias(c) for c in columns], *parts)
            .unpivot([*parts], columns, "column_name", "value").filter(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(*[F.sum(p).alias(p) for p in parts]))


def strongest(sums: DataFrame, columns: list[str], total: Column) -> DataFrame:
    """``(column_name, position, value, diff)``: per column the value that moved most in the direction of ``total``, the change
    over all rows. Only values seen in both periods count."""
    moved = sums.filter("in1 > 0 and in2 > 0").select(
        "column_name", "value", (F.coalesce("second", F.lit(0.0)) - F.coalesce("first", F.lit(0.0))).alias("diff"))
    per_column = moved.groupBy("column_name").agg(
        F.min_by("value", F.struct("diff", "value")).alias("drop_value"), F.min("diff").alias("drop"),
        F.min_by("value", F.struct(-F.col("diff"), F.col("value"))).alias("rise_value"), F.max("diff").alias("rise"))
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column_name"))
    fell, rose = (total < 0) & (F.col("drop") < 0), (total > 0) & (F.col("rise") > 0)
    return (per_column.filter(fell | rose)
            .select("column_name", order.cast("int").alias("position"),
                    F.when(fell, F.col("drop_value")).otherwise(F.col("rise_value")).alias("value"),
                    F.when(fell, F.col("drop")).otherwise(F.col("rise")).alias("diff"))
            .orderBy("position"))


def drivers(marked: DataFrame, columns: list[str], measure: str, compared: DataFrame) -> DataFrame:
    """The strongest values of the category columns of marked rows; ``compared`` is the frame of :func:`compare_periods`.

    Rows are summed per combination of categories first, map-side, and only the sums are unpivoted.
    """
    sums = sums_by(period_sums(marked, columns, measure), columns)
    return strongest(sums, columns, compared.select("delta").scalar())


def recommendations(losses: DataFrame, key: str, best: DataFrame, compared: DataFrame) -> DataFrame:
    """``(rule, recommendation)``: largest loss, best seller, and a falling total."""
    # The sentences.
    worst = losses.limit(1).select(F.lit(1).alias("rule"), F.concat(
        F.lit("Review pricing or discontinue '"), F.col(key),
        F.lit("' as it is currently generating the largest loss.")).alias("recommendation"))
    push = best.filter(F.col("best").isNotNull()).select(F.lit(2).alias("rule"), F.concat(
        F.lit("Increase inventory and marketing spend for '"), F.col("best"),
        F.lit("' to capitalize on high sales velocity.")).alias("recommendation"))
    falling = compared.filter(F.col("direction") == "decreased").select(F.lit(3).alias("rule"), F.lit(
        "Overall metric trend is downward. Implement targeted promotional discounts for dropping segments."
    ).alias("recommendation"))
    return worst.unionByName(push).unionByName(falling)
