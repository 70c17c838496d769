"""Daily forecasts for many series: autoregression of order 5 on daily changes.

The fit is conditional least squares without a constant. Spark adds up each series' cross products (20 numbers per
series), so no task ever holds a series' rows; the small linear solve and the recursion run on one row per series.
The estimator differs slightly from an exact maximum-likelihood ARIMA(5,1,0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tabularium.operators import series

# Order, shortest series, days ahead, width of the 95 % band.
ORDER, MIN_POINTS, HORIZON, BAND = 5, 30, 30, 1.959963984540054


def lags(days: DataFrame, by: str, order: int = ORDER) -> DataFrame:
    """Add the daily change and its lags 1..order; a series has one row per calendar day."""
    w = W.partitionBy(by).orderBy("period")
    out = days.withColumn("change", F.col("total") - F.lag("total").over(w))
    return out.withColumns({f"lag{k}": F.lag("change", k).over(w) for k in range(1, order + 1)})


def status(days: DataFrame, by: str) -> DataFrame:
    """``(by, points, status, reason)``: series shorter than 30 days are skipped."""
    short = F.col("points") < MIN_POINTS
    return days.groupBy(by).agg(F.count(F.lit(1)).alias("points")).select(
        by, "points", F.when(short, "skipped").otherwise("success").alias("status"),
        F.when(short, "insufficient_time_points_min_30").alias("reason"))


def forecast(df: DataFrame, by: str, moment: str, measure: str, steps: int = HORIZON) -> DataFrame:
    """``(by, step, day, forecast, lower, upper)`` for every series that is long enough."""
    import numpy as np
    import pandas as pd

    lagged = lags(series.daily(df, moment, measure, [by]), by)
    x = [f"lag{k}" for k in range(1, ORDER + 1)]
    full = F.col(x[-1]).isNotNull()
    sums = [F.sum(F.when(full, F.col(a) * F.col(b))).alias(f"{a}_{b}") for i, a in enumerate(x) for b in x[i:]]
    sums += [F.sum(F.when(full, F.col("change") * F.col(a))).alias(f"y_{a}") for a in x]
    recent = F.max_by(F.array("total", "change", *[F.coalesce(c, F.lit(0.0)) for c in x[:-1]]), F.col("period"))
    fits = lagged.groupBy(by).agg(F.count(F.lit(1)).alias("points"), F.sum(F.when(full, F.col("change") * F.col("change"))).alias("yy"),
                                  F.count_if(full).alias("used"), F.max("period").alias("last"), recent.alias("recent"), *sums)
    fits = fits.filter(F.col("points") >= MIN_POINTS)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                xx = np.zeros((ORDER, ORDER))
                for i, a in enumerate(x):
                    for j in range(i, ORDER):
                        xx[i, j] = xx[j, i] = row[f"{a}_{x[j]}"]
                xy = np.array([row[f"y_{a}"] for a in x])
                phi = np.linalg.lstsq(xx, xy, rcond=None)[0]
                spread = max(row["yy"] - 2 * phi @ xy + phi @ xx @ phi, 0.0) / max(row["used"] - ORDER, 1)
                level, past = row["recent"][0], list(row["recent"][1:])
                weights, total, variance = [1.0], 0.0, 0.0
                for step in range(1, steps + 1):
                    change = float(phi @ np.array(past[:ORDER]))
                    past = [change, *past]
                    level += change
                    total += weights[-1]
                    variance += total * total
                    weights.append(sum(phi[k] * weights[-1 - k] for k in range(min(ORDER, len(weights)))))
                    half = BAND * (spread * variance) ** 0.5
                    out.append((row[by], step, row["last"] + pd.Timedelta(days=step), level, level - half, level + half))
            yield pd.DataFrame(out, columns=[by, "step", "day", "forecast", "lower", "upper"])

    kind = df.schema[by].dataType.simpleString()
    return fits.mapInPandas(solve, f"`{by}` {kind}, step int, day date, forecast double, lower double, upper double")
