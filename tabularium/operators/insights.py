"""Rule-based findings as ``(type, severity, description)`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The rules' limits.
Z_LIMIT, MANY_ANOMALIES = 3.0, 10
STRONG_R = 0.6
DROP_WARNING, DROP_CRITICAL, RISE_INFO = -15.0, -30.0, 20.0
THIN_MARGIN = 0.05


def anomaly_count(df: DataFrame, measure: str) -> Column:
    """Rows more than 3 population standard deviations from the mean, null read as 0 — as a one-row frame."""
    value = F.coalesce(F.col(measure), F.lit(0.0))
    s = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))).scalar()
    return df.agg(F.count_if(F.abs(value - s["mean"]) > F.lit(Z_LIMIT) * s["std"]).alias("anomalies"))


def anomalies(df: DataFrame, measure: str) -> DataFrame:
    n = F.col("anomalies")
    return anomaly_count(df, measure).filter(n > 0).select(
        F.lit("anomaly_detection").alias("type"),
        F.when(n < MANY_ANOMALIES, "warning").otherwise("critical").alias("severity"),
        F.concat(F.lit("Detected "), n.cast("string"), F.lit(
            f" severe statistical anomalies in '{measure}' based on a 3-sigma Z-score threshold.")).alias("description"))


def _text(c: Column, digits: int) -> Column:
    return F.round(c, digits).cast("string")


def trend(fit: DataFrame, measure: str) -> DataFrame:
    """From a one-row trend frame (see ``series.trend``), at least three periods."""
    up = (F.col("slope") > 0) & (F.col("r") > STRONG_R)
    down = (F.col("slope") < 0) & (F.col("r") < -STRONG_R)
    return fit.filter((F.col("periods") >= 3) & (up | down)).select(
        F.lit("trend_slope").alias("type"), F.when(up, "info").otherwise("critical").alias("severity"),
        F.when(up, F.concat(F.lit(f"Strong positive linear acceleration detected in {measure} over time (R²="),
                            _text(F.col("r") * F.col("r"), 2), F.lit(").")))
        .otherwise(F.lit(f"Severe declining demand detected in {measure} across the dataset timeline."))
        .alias("description"))


def recent_change(change: DataFrame, measure: str) -> DataFrame:
    """From a one-row change frame (see ``series.last_change``)."""
    pct = F.col("change_pct")
    return change.filter((F.col("previous") > 0) & ((pct <= DROP_WARNING) | (pct >= RISE_INFO))).select(
        F.when(pct < 0, "declining_performance").otherwise("accelerating_performance").alias("type"),
        F.when(pct >= RISE_INFO, "info").when(pct > DROP_CRITICAL, "warning").otherwise("critical").alias("severity"),
        F.when(pct < 0, F.concat(F.lit(f"Recent {measure} dropped significantly by "), _text(F.abs(pct), 1),
                                 F.lit("% between the last two recorded months.")))
        .otherwise(F.concat(F.lit(f"Recent {measure} spiked heavily by "), _text(pct, 1),
                            F.lit("% in the most recent month."))).alias("description"))


def margin(metrics: DataFrame) -> DataFrame:
    """From ``(metric, value)`` rows: a thin or negative profit margin; exactly 0 says nothing."""
    m = F.col("value")
    return metrics.filter((F.col("metric") == "profit_margin") & (m < THIN_MARGIN) & (m != 0)).select(
        F.lit("profitability").alias("type"), F.when(m > 0, "warning").otherwise("critical").alias("severity"),
        F.when(m > 0, F.concat(F.lit("Overall profit margin is critically thin at "), _text(m * 100, 2), F.lit("%.")))
        .otherwise(F.lit("Dataset exhibits a net-negative profitability margin.")).alias("description"))
