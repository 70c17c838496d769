"""Registered KPI, metric, insight, chart and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions.numbers import display2_sql, r4
from tabularium.operators import charts, filters, insights, kpi, metrics, ordering, series, stats
from tabularium.plans.inputs import (
    DIRTY_SQL, SALES_SQL, dirty_lineitem, net_sales, sales_by_customer, sales_by_order, sales_by_part, sales_wide,
)
from tabularium.plans.registry import query
from tabularium.session import written

LINE_KEYS = ["order_key", "line_no", "part_key", "supp_key"]


# ---- KPIs ----------------------------------------------------------------------------------------------

@query("kpi_by_product", f"""WITH {SALES_SQL}
SELECT product, round(sum(sales), 4) AS sales, round(sum(profit), 4) AS profit, sum(quantity) AS quantity
FROM sales_wide WHERE product IS NOT NULL GROUP BY product""")
def kpi_by_product(t):
    parts = sales_by_part(t).filter(F.col("product").isNotNull())
    return (parts.groupBy("product")
            .agg(r4(F.sum("sales")).alias("sales"), r4(F.sum("profit")).alias("profit"), F.sum("quantity").alias("quantity"))
            .orderBy(F.desc("sales"), "product"))


@query("kpi_summary", f"""WITH {SALES_SQL}
SELECT round(sum(sales), 4) AS total_sales, round(avg(sales), 4) AS average_order_value,
  round(sum(profit), 4) AS total_profit,
  CASE WHEN sum(sales) > 0 THEN round(sum(profit) / sum(sales) * 100, 4) END AS profit_margin_percentage
FROM sales_wide""")
def kpi_summary(t):
    one = kpi.summary(sales_wide(t, ["sales", "profit"]), "sales", "profit")
    return one.select(*[r4(F.col(c)).alias(c) for c in one.columns])


def _extremes_sql(key: str) -> str:
    return f"""SELECT '{key}' AS dimension,
  (SELECT {key} FROM g_{key} ORDER BY v DESC, {key} LIMIT 1) AS best, (SELECT round(max(v), 4) FROM g_{key}) AS best_total,
  (SELECT {key} FROM g_{key} ORDER BY v, {key} LIMIT 1) AS worst, (SELECT round(min(v), 4) FROM g_{key}) AS worst_total"""


@query("kpi_best_worst", f"""WITH {SALES_SQL},
g_product AS (SELECT product, sum(sales) AS v FROM sales_wide GROUP BY 1),
g_region AS (SELECT region, sum(sales) AS v FROM sales_wide GROUP BY 1)
{_extremes_sql('product')} UNION ALL {_extremes_sql('region')}""")
def kpi_best_worst(t):
    out = None
    for key, frame in (("product", sales_by_part(t)), ("region", sales_by_customer(t))):
        one = kpi.best_and_worst(kpi.group_totals(frame, key, "sales"), key).select(
            F.lit(key).alias("dimension"), "best", r4(F.col("best_total")).alias("best_total"),
            "worst", r4(F.col("worst_total")).alias("worst_total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("profitability", f"""WITH {SALES_SQL},
g AS (SELECT product, sum(profit) AS v FROM sales_wide GROUP BY 1)
SELECT 'loss' AS kind, product, round(-v, 4) AS amount FROM g WHERE v < 0
UNION ALL SELECT 'top', product, round(v, 4) FROM (SELECT * FROM g WHERE v > 0 ORDER BY v DESC, product DESC LIMIT 5)""")
def profitability(t):
    totals = kpi.group_totals(sales_by_part(t), "product", "profit")
    losses = kpi.loss_makers(totals, "product").select(F.lit("loss").alias("kind"), "product", r4(F.col("loss")).alias("amount"))
    best = kpi.winners(totals, "product").select(F.lit("top").alias("kind"), "product", r4(F.col("total")).alias("amount"))
    return losses.unionByName(best)


@query("profitability_by_part", """WITH g AS (
  SELECT l_partkey AS part, sum(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT 'loss' AS kind, part, round(-v, 4) AS amount FROM g WHERE v < 0
UNION ALL SELECT 'top', part, round(v, 4) FROM (SELECT * FROM g WHERE v > 0 ORDER BY v DESC, part DESC LIMIT 5)""")
def profitability_by_part(t):
    totals = kpi.group_totals(sales_wide(t, ["part_key", "profit"]).withColumnRenamed("part_key", "part"), "part", "profit")
    losses = kpi.loss_makers(totals, "part").select(F.lit("loss").alias("kind"), "part", r4(F.col("loss")).alias("amount"))
    best = kpi.winners(totals, "part").select(F.lit("top").alias("kind"), "part", r4(F.col("total")).alias("amount"))
    return losses.unionByName(best)


# ---- period comparison ---------------------------------------------------------------------------------

TIES = [*LINE_KEYS, "quantity", "sales"]
HALVES_SQL = f"""{SALES_SQL}, marked AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY order_date, order_key, line_no,
  part_key, supp_key, quantity, sales) - 1 >= (SELECT count(*) // 2 FROM sales_wide) THEN 2 ELSE 1 END AS period
  FROM sales_wide)"""
PERIOD_SQL = """cmp AS (SELECT sum(CASE WHEN period = 1 THEN sales END) AS a, sum(CASE WHEN period = 2 THEN sales END) AS b
  FROM marked)"""


def _halves(t):
    """Sales of all lines marked by half."""
    lean = sales_wide(t, ["order_date", *TIES])
    split = ordering.split_written(lean, "order_date", TIES, ["sales"])
    return kpi.halves(split, F.col("second")).drop("second")


@query("rca_period_compare", f"""WITH {HALVES_SQL}, {PERIOD_SQL}
SELECT round(a, 4) AS first_total, round(b, 4) AS second_total, round(b - a, 4) AS delta,
  CASE WHEN b - a > 0 THEN 'increased' ELSE 'decreased' END AS direction,
  CASE WHEN a > 0 THEN round((b - a) / a * 100, 2) ELSE 0.0 END AS change_pct FROM cmp""")
def rca_period_compare(t):
    one = kpi.compare_periods(_halves(t), "sales")
    return one.select(*[r4(F.col(c)).alias(c) for c in ("first_total", "second_total", "delta")], "direction",
                      (F.round("change_pct", 2) + F.lit(0.0)).alias("change_pct"))


CATEGORIES = ["product", "customer", "region", "segment"]


@query("rca_drivers", f"""WITH {HALVES_SQL}, {PERIOD_SQL},
long AS (UNPIVOT (SELECT period, sales, {', '.join(CATEGORIES)} FROM marked) ON {', '.join(CATEGORIES)}
  INTO NAME column_name VALUE value),
d AS (SELECT column_name, value, sum(CASE WHEN period = 2 THEN sales END) - sum(CASE WHEN period = 1 THEN sales END) AS diff
  FROM long GROUP BY 1, 2 HAVING count(*) FILTER (period = 1) > 0 AND count(*) FILTER (period = 2) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY diff, value) AS low,
  row_number() OVER (PARTITION BY column_name ORDER BY diff DESC, value) AS high FROM d)
SELECT column_name, CAST(list_position(['product', 'customer', 'region', 'segment'], column_name) AS INTEGER) AS position,
  value, round(diff, 4) AS diff FROM r, cmp
WHERE (b - a < 0 AND low = 1 AND diff < 0) OR (b - a > 0 AND high = 1 AND diff > 0)""")
def rca_drivers(t):
    """Lines are marked once and summed per part and per customer; the names are joined to the sums."""
    lean = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("order_date"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), F.col("l_quantity").alias("quantity"),
        net_sales().alias("sales"), F.col("o_custkey").alias("cust_key"))
    split = ordering.split_written(lean, "order_date", TIES, ["part_key", "cust_key", "sales"])
    marked = kpi.halves(split, F.col("second")).drop("second")
    per_part = written(kpi.period_sums(marked, ["part_key"], "sales"), "part-sums")
    parts = per_part.join(t.part, F.col("part_key") == F.col("p_partkey")).withColumnRenamed("p_brand", "product")
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    people = (kpi.period_sums(marked, ["cust_key"], "sales").join(t.customer, F.col("cust_key") == F.col("c_custkey"))
              .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
              .withColumnsRenamed({"c_name": "customer", "r_name": "region", "c_mktsegment": "segment"}))
    sums = kpi.sums_by(parts, ["product"]).unionByName(kpi.sums_by(people, ["customer", "region", "segment"]))
    total = per_part.agg(F.sum(F.coalesce("second", F.lit(0.0))) - F.sum(F.coalesce("first", F.lit(0.0)))).scalar()
    return kpi.strongest(sums, CATEGORIES, total).withColumn("diff", r4(F.col("diff")))


@query("recommendations", f"""WITH {HALVES_SQL}, {PERIOD_SQL}, g AS (
  SELECT product, sum(sales) AS s, sum(profit) AS p FROM sales_wide GROUP BY 1),
parts AS (SELECT part_key AS part, sum(profit) AS p FROM sales_wide GROUP BY 1)
SELECT 1 AS rule, 'Review pricing or discontinue ''' || part || ''' as it is currently generating the largest loss.'
  AS recommendation FROM (SELECT part FROM parts WHERE p < 0 ORDER BY p, part LIMIT 1)
UNION ALL SELECT 2, 'Increase inventory and marketing spend for ''' || product ||
  ''' to capitalize on high sales velocity.' FROM (SELECT product FROM g ORDER BY s DESC, product LIMIT 1)
UNION ALL SELECT 3, 'Overall metric trend is downward. Implement targeted promotional discounts for dropping segments.'
  FROM cmp WHERE b - a <= 0""")
def recommendations(t):
    """Lines are summed per part before parts are joined; a line without sales or quantity has no profit."""
    sales, whole = net_sales(), net_sales().isNotNull() & F.col("l_quantity").isNotNull()
    sums = written(t.lineitem.groupBy("l_partkey").agg(
        F.sum(sales).alias("sales"), F.sum(F.when(whole, sales)).alias("_sales"), F.sum(F.when(whole, F.col("l_quantity"))).alias("_quantity")), "part-sums")
    named = sums.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("part"), F.col("p_brand").alias("product"), "sales",
        (F.col("_sales") - F.col("_quantity") * F.col("p_retailprice")).alias("profit"))
    losses = kpi.loss_makers(kpi.group_totals(named, "part", "profit"), "part").withColumn("part", F.col("part").cast("string"))
    best = kpi.best_and_worst(kpi.group_totals(named, "product", "sales"), "product")
    return kpi.recommendations(losses, "part", best, kpi.compare_periods(_halves(t), "sales"))


# ---- metrics and insights ------------------------------------------------------------------------------

MONTHS_SQL = """months AS (
  SELECT s.m AS period, coalesce(g.total, 0) AS total FROM (
    SELECT CAST(unnest(generate_series(min(date_trunc('month', order_date)), max(date_trunc('month', order_date)),
      INTERVAL 1 MONTH)) AS DATE) AS m FROM sales_wide) s
  LEFT JOIN (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, sum(sales) AS total FROM sales_wide GROUP BY 1) g
  USING (m))"""
CHANGE_SQL = """change AS (SELECT period, total AS last, previous, (total - previous) / nullif(previous, 0) * 100 AS pct
  FROM (SELECT *, lag(total) OVER (ORDER BY period) AS previous FROM months) ORDER BY period DESC LIMIT 1)"""


@query("metric_base", """SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS total,
  round(avg(l_extendedprice * (1 - l_discount)), 4) AS mean, round(max(l_extendedprice * (1 - l_discount)), 4) AS highest,
  round(min(l_extendedprice * (1 - l_discount)), 4) AS lowest FROM lineitem""")
def metric_base(t):
    s = F.col("sales")
    return sales_wide(t, ["sales"]).agg(r4(F.sum(s)).alias("total"), r4(F.avg(s)).alias("mean"),
                                        r4(F.max(s)).alias("highest"), r4(F.min(s)).alias("lowest"))


@query("metric_all", f"""WITH {SALES_SQL}, {MONTHS_SQL}, {CHANGE_SQL}, b AS (
  SELECT sum(sales) AS s, avg(sales) AS a, sum(profit) AS p, sum(quantity) AS q FROM sales_wide)
SELECT 'total_sales' AS metric, round(s, 4) AS value FROM b UNION ALL SELECT 'average_sales', round(a, 4) FROM b
UNION ALL SELECT 'monthly_sales_growth', (SELECT round(pct, 4) FROM change) UNION ALL SELECT 'total_revenue', round(s, 4) FROM b
UNION ALL SELECT 'total_profit', round(p, 4) FROM b UNION ALL SELECT 'total_quantity', round(q, 4) FROM b
UNION ALL SELECT 'profit_margin', round(p / nullif(s, 0), 4) FROM b
UNION ALL SELECT 'inferred_total_cost', round(s - p, 4) FROM b
UNION ALL SELECT 'average_order_value', round(s / nullif(q, 0), 4) FROM b""")
def metric_all(t):
    wanted = metrics.definitions("sales", "profit", None, "quantity", "order_date")
    return metrics.evaluate(sales_wide(t, ["sales", "profit", "quantity", "order_date"]), wanted)


@query("metric_mom_growth", f"""WITH {SALES_SQL}, {MONTHS_SQL}, {CHANGE_SQL}
SELECT period, round(last, 4) AS last, round(previous, 4) AS previous, round(pct, 4) AS change_pct FROM change""")
def metric_mom_growth(t):
    one = series.last_change(series.monthly(sales_by_order(t), "order_date", "sales"))
    return one.select("period", *[r4(F.col(c)).alias(c) for c in ("last", "previous", "change_pct")])


@query("ts_monthly", f"""WITH {SALES_SQL}, {MONTHS_SQL} SELECT period, round(total, 4) AS total FROM months""")
def ts_monthly(t):
    return series.monthly(sales_by_order(t), "order_date", "sales").withColumn("total", r4(F.col("total")))


@query("ts_daily_fill", f"""WITH {SALES_SQL}
SELECT s.d AS period, round(coalesce(g.total, 0), 4) AS total FROM (
  SELECT CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE) AS d FROM sales_wide) s
LEFT JOIN (SELECT CAST(order_date AS DATE) AS d, sum(sales) AS total FROM sales_wide GROUP BY 1) g USING (d)""")
def ts_daily_fill(t):
    return series.daily(sales_by_order(t), "order_date", "sales").withColumn("total", r4(F.col("total")))


@query("trend_slope", f"""WITH {SALES_SQL}, {MONTHS_SQL}, f AS (
  SELECT count(*) AS periods, regr_slope(total, x) AS slope, regr_intercept(total, x) AS intercept, corr(total, x) AS r
  FROM (SELECT total, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS x FROM months))
SELECT periods, round(slope, 2) AS slope, round(intercept, 2) AS intercept, round(r, 4) AS r,
  CASE WHEN slope > 0 AND r > 0.6 THEN 'info' WHEN slope < 0 AND r < -0.6 THEN 'critical' ELSE 'none' END AS severity
FROM f""")
def trend_slope(t):
    fit = series.trend(series.monthly(sales_by_order(t), "order_date", "sales"))
    slope, r = F.col("slope"), F.col("r")
    severity = (F.when((slope > 0) & (r > insights.STRONG_R), "info")
                .when((slope < 0) & (r < -insights.STRONG_R), "critical").otherwise("none"))
    return fit.select("periods", F.round(slope, 2).alias("slope"), F.round("intercept", 2).alias("intercept"),
                      F.round(r, 4).alias("r"), severity.alias("severity"))


@query("insight_anomalies", f"""WITH {DIRTY_SQL}, s AS (
  SELECT avg(coalesce(price, 0)) AS m, stddev_pop(coalesce(price, 0)) AS d FROM dirty),
n AS (SELECT count(*) AS c FROM dirty, s WHERE abs(coalesce(price, 0) - m) > 3 * d)
SELECT 'anomaly_detection' AS type, CASE WHEN c < 10 THEN 'warning' ELSE 'critical' END AS severity,
  'Detected ' || c || ' severe statistical anomalies in ''price'' based on a 3-sigma Z-score threshold.' AS description
FROM n WHERE c > 0""")
def insight_anomalies(t):
    return insights.anomalies(dirty_lineitem(t).select("price"), "price")


RECENT_SQL = """SELECT CASE WHEN pct < 0 THEN 'declining_performance' ELSE 'accelerating_performance' END AS type,
  CASE WHEN pct >= 20 THEN 'info' WHEN pct > -30 THEN 'warning' ELSE 'critical' END AS severity,
  CASE WHEN pct < 0 THEN 'Recent sales dropped significantly by ' || round(abs(pct), 1) ||
    '% between the last two recorded months.'
  ELSE 'Recent sales spiked heavily by ' || round(pct, 1) || '% in the most recent month.' END AS description
FROM change WHERE previous > 0 AND (pct <= -15 OR pct >= 20)"""


@query("insight_recent_change", f"WITH {SALES_SQL}, {MONTHS_SQL}, {CHANGE_SQL} {RECENT_SQL}")
def insight_recent_change(t):
    change = series.last_change(series.monthly(sales_by_order(t), "order_date", "sales"))
    return insights.recent_change(change, "sales")


def _margin_sql(cost: str) -> str:
    return f"""SELECT 'profitability' AS type, CASE WHEN m > 0 THEN 'warning' ELSE 'critical' END AS severity,
  CASE WHEN m > 0 THEN 'Overall profit margin is critically thin at ' || round(m * 100, 2) || '%.'
  ELSE 'Dataset exhibits a net-negative profitability margin.' END AS description
FROM (SELECT round(sum(sales - {cost}) / nullif(sum(sales), 0), 4) AS m FROM sales_wide) WHERE m < 0.05 AND m <> 0"""


@query("insight_margin", f"WITH {SALES_SQL} {_margin_sql('quantity * price * 2')}")
def insight_margin(t):
    """Margin check with a cost of twice the list price, which makes the margin negative."""
    wide = sales_wide(t, ["sales", "quantity", "price"]).select(
        "sales", (F.col("sales") - F.col("quantity") * F.col("price") * 2).alias("profit"))
    return insights.margin(metrics.evaluate(wide, metrics.definitions("sales", "profit")))


@query("insights_all", f"""WITH {SALES_SQL}, {MONTHS_SQL}, {CHANGE_SQL}, f AS (
  SELECT count(*) AS periods, regr_slope(total, x) AS slope, corr(total, x) AS r
  FROM (SELECT total, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS x FROM months)),
z AS (SELECT count(*) AS c FROM sales_wide, (SELECT avg(sales) AS m, stddev_pop(sales) AS d FROM sales_wide)
  WHERE abs(sales - m) > 3 * d)
SELECT 'anomaly_detection' AS type, CASE WHEN c < 10 THEN 'warning' ELSE 'critical' END AS severity,
  'Detected ' || c || ' severe statistical anomalies in ''sales'' based on a 3-sigma Z-score threshold.' AS description
FROM z WHERE c > 0
UNION ALL SELECT 'trend_slope', CASE WHEN slope > 0 THEN 'info' ELSE 'critical' END,
  CASE WHEN slope > 0 THEN 'Strong positive linear acceleration detected in sales over time (R²=' || round(r * r, 2) || ').'
  ELSE 'Severe declining demand detected in sales across the dataset timeline.' END
FROM f WHERE periods >= 3 AND ((slope > 0 AND r > 0.6) OR (slope < 0 AND r < -0.6))
UNION ALL {RECENT_SQL} UNION ALL {_margin_sql('quantity * price')}""")
def insights_all(t):
    wide = sales_wide(t, ["sales", "profit"])
    months = series.monthly(sales_by_order(t), "order_date", "sales")
    found = metrics.evaluate(wide.select("sales", "profit"), metrics.definitions("sales", "profit"))
    return (insights.anomalies(sales_wide(t, ["sales"]), "sales")
            .unionByName(insights.trend(series.trend(months), "sales"))
            .unionByName(insights.recent_change(series.last_change(months), "sales"))
            .unionByName(insights.margin(found)))


# ---- charts --------------------------------------------------------------------------------------------

CHART_WHERE = "WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD') AND l_quantity >= 5 AND l_quantity <= 45"
CHART_FILTERS = {"p_type": ["ECONOMY", "PROMO", "STANDARD"], "l_quantity": {"min": 5, "max": 45}, "no_such_column": ["x"]}


def _chart_input(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_brand", "p_type", "l_quantity", "l_extendedprice", "l_returnflag")


def _chart_sql(value: str, x: str = "p_brand", limit: int = 10) -> str:
    return f"""SELECT substr(coalesce(nullif({x}, ''), 'Unknown'), 1, 18) AS name, {value} AS value, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey {CHART_WHERE}
GROUP BY coalesce(nullif({x}, ''), 'Unknown') ORDER BY 2 DESC, 1 LIMIT {limit}"""


@query("chart_sum", _chart_sql(display2_sql("sum(l_extendedprice)")))
def chart_sum(t):
    return charts.aggregate(_chart_input(t), "p_brand", "l_extendedprice", "sum", CHART_FILTERS)


@query("chart_avg", _chart_sql(display2_sql("avg(l_extendedprice)")))
def chart_avg(t):
    return charts.aggregate(_chart_input(t), "p_brand", "l_extendedprice", "avg", CHART_FILTERS)


@query("chart_minmax", f"""SELECT 'max' AS how, * FROM ({_chart_sql(display2_sql('max(l_extendedprice)'))})
UNION ALL SELECT 'min', * FROM ({_chart_sql(display2_sql('min(l_extendedprice)'))})""")
def chart_minmax(t):
    high = charts.aggregate(_chart_input(t), "p_brand", "l_extendedprice", "max", CHART_FILTERS)
    low = charts.aggregate(_chart_input(t), "p_brand", "l_extendedprice", "min", CHART_FILTERS)
    return high.select(F.lit("max").alias("how"), "*").unionByName(low.select(F.lit("min").alias("how"), "*"))


@query("chart_count", _chart_sql("CAST(count(*) AS DOUBLE)"))
def chart_count(t):
    return charts.aggregate(_chart_input(t), "p_brand", None, "count", CHART_FILTERS)


@query("chart_share", f"""WITH {SALES_SQL}, g AS (
  SELECT segment AS name, sum(sales) AS value FROM sales_wide GROUP BY 1 HAVING sum(sales) > 0)
SELECT name, {display2_sql('value')} AS value, round(value * 100.0 / (SELECT sum(value) FROM g), 1) AS pct FROM g
ORDER BY value DESC, name LIMIT 8""")
def chart_share(t):
    """Donut over the first text column with 2 to 12 different values."""
    people = sales_by_customer(t)
    columns = ["customer", "segment", "region"]
    x = charts.first_category(stats.nunique(t.customer.select(
        F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment")), columns[:2]), columns, 13, 2)
    return charts.share(people, x, "sales")


@query("chart_totals", f"""WITH c AS ({_chart_sql(display2_sql('sum(l_extendedprice)'))})
SELECT round(sum(value), 4) AS total, CAST(sum(n) AS BIGINT) AS records, round(sum(value) / sum(n), 4) AS average FROM c""")
def chart_totals(t):
    one = charts.footer(chart_sum(t))
    return one.select(r4(F.col("total")).alias("total"), "records", r4(F.col("average")).alias("average"))


def _top_sql(x: str, y: str, n: int) -> str:
    return f"""SELECT substr({x}, 1, 20) AS x, round(sum({y}), 4) AS y FROM sales_wide WHERE {x} IS NOT NULL
GROUP BY {x} ORDER BY 2 DESC, 1 LIMIT {n}"""


SERIES_SQL = """SELECT * FROM (SELECT strftime(order_date, '%Y-%m') AS x, round(sum({y}), 4) AS y FROM sales_wide GROUP BY 1
ORDER BY 1 DESC LIMIT 30)"""


def _many(t) -> bool:
    """More orders than points on a chart; the count comes from the file footers."""
    return t.orders.count() > 30


@query("chart_time_series", f"WITH {SALES_SQL} {SERIES_SQL.format(y='sales')}")
def chart_time_series(t):
    return charts.time_series(sales_by_order(t), "order_date", "sales", many=_many(t)).withColumn("y", r4(F.col("y")))


@query("chart_top_products", f"WITH {SALES_SQL} {_top_sql('product', 'sales', 10)}")
def chart_top_products(t):
    return charts.top(sales_by_part(t), "product", "sales").withColumn("y", r4(F.col("y")))


@query("chart_region", f"WITH {SALES_SQL} {_top_sql('region', 'sales', 10)}")
def chart_region(t):
    return charts.top(sales_by_customer(t), "region", "sales").withColumn("y", r4(F.col("y")))


@query("chart_top_customers", f"WITH {SALES_SQL} {_top_sql('customer', 'sales', 8)}")
def chart_top_customers(t):
    return charts.top(sales_by_customer(t), "customer", "sales", 8).withColumn("y", r4(F.col("y")))


@query("chart_customers_fallback", f"WITH {SALES_SQL} {_top_sql('segment', 'sales', 8)}")
def chart_customers_fallback(t):
    """Without a customer role: the first text column with fewer than 30 values."""
    counts = stats.nunique(t.customer.select(F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment")),
                           ["customer", "segment"])
    x = charts.first_category(counts, ["customer", "segment"], 30)
    return charts.top(sales_by_customer(t), x, "sales", 8).withColumn("y", r4(F.col("y")))


@query("chart_qty", f"WITH {SALES_SQL} {_top_sql('product', 'quantity', 10)}")
def chart_qty(t):
    return charts.top(sales_by_part(t), "product", "quantity").withColumn("y", r4(F.col("y")))


@query("chart_profit_trend", f"WITH {SALES_SQL} {SERIES_SQL.format(y='profit')}")
def chart_profit_trend(t):
    wide = sales_wide(t, ["order_date", "profit"])
    return charts.time_series(wide, "order_date", "profit", many=_many(t)).withColumn("y", r4(F.col("y")))


@query("chart_revenue_area", f"WITH {SALES_SQL}, {MONTHS_SQL} SELECT strftime(period, '%Y-%m') AS x, round(total, 4) AS y FROM months")
def chart_revenue_area(t):
    months = series.monthly(sales_by_order(t), "order_date", "sales")
    return months.select(F.date_format("period", "yyyy-MM").alias("x"), r4(F.col("total")).alias("y"))


@query("chart_revenue_cumulative", f"""WITH {SALES_SQL}, {MONTHS_SQL}
SELECT strftime(period, '%Y-%m') AS x, round(sum(total) OVER (ORDER BY period), 4) AS y FROM months""")
def chart_revenue_cumulative(t):
    months = series.running_total(series.monthly(sales_by_order(t), "order_date", "sales"))
    return months.select(F.date_format("period", "yyyy-MM").alias("x"), r4(F.col("running")).alias("y"))


@query("chart_extra", f"""WITH {SALES_SQL}, g AS (SELECT region AS x, sum(quantity) AS quantity, sum(price) AS price,
  sum(profit) AS profit FROM sales_wide GROUP BY 1), long AS (
  UNPIVOT g ON quantity, price, profit INTO NAME measure VALUE y)
SELECT measure, CAST(row_number() OVER (PARTITION BY measure ORDER BY y DESC, x) AS INTEGER) AS rank, x, round(y, 4) AS y
FROM long""")
def chart_extra(t):
    wide = sales_wide(t, ["region", "quantity", "price", "profit"])
    return charts.all_categories(wide, "region", ["quantity", "price", "profit"]).withColumn("y", r4(F.col("y")))


def _board_sql(chart_id: str, kind: str, sql: str, order: str) -> str:
    return (f"SELECT '{chart_id}' AS chart_id, '{kind}' AS chart_type, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) "
            f"AS rank, x, round(y, 4) AS y FROM ({sql})")


@query("dashboard_all", f"WITH {SALES_SQL} " + " UNION ALL ".join([
    _board_sql("trend_line", "line", SERIES_SQL.format(y="sales"), "x"),
    _board_sql("product_bar", "bar", _top_sql("product", "sales", 10), "y DESC, x"),
    _board_sql("region_pie", "pie", _top_sql("region", "sales", 10), "y DESC, x"),
    _board_sql("revenue_area", "area", SERIES_SQL.format(y="sales"), "x"),
    _board_sql("customer_bar", "bar", _top_sql("customer", "sales", 8), "y DESC, x"),
    _board_sql("qty_bar", "bar", _top_sql("product", "quantity", 10), "y DESC, x"),
    _board_sql("profit_trend", "area", SERIES_SQL.format(y="profit"), "x")]))
def dashboard_all(t):
    """All charts as ranked rows, from three sums that are written once: per part, per customer and per month."""
    parts, people = written(sales_by_part(t), "part-sums"), written(sales_by_customer(t), "customer-sums")
    lines = sales_wide(t, ["order_date", "sales", "profit"])
    month = F.date_format("order_date", "yyyy-MM")
    monthly = written(lines.groupBy(month.alias("x")).agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("n")), "month-sums")
    many = (monthly.agg(F.sum("n")).first()[0] or 0) > 30

    def trend(measure):
        if not many:
            return charts.time_series(lines, "order_date", measure, many=False)
        return monthly.filter(F.col("x").isNotNull()).orderBy(F.desc("x")).limit(30).select("x", F.col(measure).alias("y"))

    boards = [
        (trend("sales"), "trend_line", "line", "x"),
        (charts.top(parts, "product", "sales"), "product_bar", "bar", "y"),
        (charts.top(people, "region", "sales"), "region_pie", "pie", "y"),
        (trend("sales"), "revenue_area", "area", "x"),
        (charts.top(people, "customer", "sales", 8), "customer_bar", "bar", "y"),
        (charts.top(parts, "product", "quantity"), "qty_bar", "bar", "y"),
        (trend("profit"), "profit_trend", "area", "x"),
    ]
    out = None
    for data, chart_id, kind, by in boards:
        rows = charts.as_rows(data.withColumn("y", r4(F.col("y"))), chart_id, kind, by)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("chart_sampled_trend", """WITH r AS (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_orderkey,
  l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn, greatest(1, count(*) OVER () // 100) AS step FROM lineitem)
SELECT CAST(rn // step + 1 AS BIGINT) AS index, round(value, 4) AS value FROM r WHERE rn % step = 0""")
def chart_sampled_trend(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    picked = ordering.every_nth(t.lineitem.select(*keys), keys)
    return picked.select((F.floor(F.col("position") / F.col("step")) + 1).cast("bigint").alias("index"),
                         r4(F.col("l_extendedprice")).alias("value"))


# ---- grid filters and paging ---------------------------------------------------------------------------

@query("flt_in_list", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus FROM lineitem "
                      "WHERE l_returnflag IN ('A', 'R') AND CAST(l_linenumber AS VARCHAR) IN ('1', '3')")
def flt_in_list(t):
    rows = t.lineitem.filter(filters.one_of("l_returnflag", ["A", "R"]) & filters.one_of("l_linenumber", [1, 3], t.lineitem)
                             & filters.one_of("l_linestatus", []))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")


@query("flt_range", f"""WITH {DIRTY_SQL} SELECT l_orderkey, l_linenumber, l_partkey, quantity, qty_text FROM dirty
WHERE quantity >= 10 AND quantity <= 20 AND qty_text <> 'n/a' AND CAST(CASE WHEN qty_text <> 'n/a' THEN qty_text END AS DOUBLE) <= 18""")
def flt_range(t):
    dirty = dirty_lineitem(t).select("l_orderkey", "l_linenumber", "l_partkey", "quantity", "qty_text")
    return dirty.filter(filters.in_range(dirty, "quantity", 10, 20) & filters.in_range(dirty, "qty_text", None, 18))


@query("flt_conjunction", f"""SELECT l_quantity, l_extendedprice, p_type, p_brand, l_returnflag
FROM lineitem JOIN part ON l_partkey = p_partkey {CHART_WHERE}""")
def flt_conjunction(t):
    return filters.matching(_chart_input(t), CHART_FILTERS)


@query("flt_search_any", """SELECT * FROM customer WHERE contains(lower(CAST(c_custkey AS VARCHAR)), '77')
  OR contains(lower(c_name), '77') OR contains(CAST(c_nationkey AS VARCHAR), '77')
  OR contains(CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR), '77') OR contains(lower(c_mktsegment), '77')""")
def flt_search_any(t):
    people = t.customer.withColumn("_text", F.col("c_acctbal").cast("decimal(18,2)"))
    columns = ["c_custkey", "c_name", "c_nationkey", "_text", "c_mktsegment"]
    return filters.containing(people, "77", columns).drop("_text")


@query("flt_search_cols", """SELECT c_custkey, c_name, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build') OR contains(lower(n_name), 'build')""")
def flt_search_cols(t):
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return filters.containing(people, "BUILD", ["c_name", "c_mktsegment", "n_name"]).select(
        "c_custkey", "c_name", "c_mktsegment", "n_name")


@query("flt_optional", """SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE contains(lower(p_name), 'red') AND p_type = 'PROMO'""")
def flt_optional(t):
    return filters.optional(t.part, {"p_type": "PROMO", "p_brand": None}, {"p_name": "Red"}).select(
        "p_partkey", "p_name", "p_brand", "p_type")


@query("prj_prune", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def prj_prune(t):
    with_index = t.lineitem.withColumn("Unnamed: 0", F.col("l_linenumber"))
    return filters.visible(with_index, ["l_orderkey", "l_quantity", "l_shipdate", "Unnamed: 0"])


@query("map_status", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'cleaned' WHEN 'P' THEN 'cleaning'
  ELSE 'not_cleaned' END AS status FROM orders""")
def map_status(t):
    # Which stored states count as which shown state.
    shown = {"cleaned": ["completed", "ready", "cleaned"], "cleaning": ["processing", "cleaning"], "failed": ["failed"]}
    stored = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing").otherwise("new")
    status = F.lit("not_cleaned")
    for name, states in shown.items():
        status = F.when(stored.isin(states), name).otherwise(status)
    return t.orders.select("o_orderkey", status.alias("status"))


@query("grid_page", """WITH g AS (SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND contains(lower(o_orderpriority), 'g'))
SELECT *, (SELECT count(*) FROM g) AS total_rows, (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM g) AS total_pages
FROM (SELECT * FROM g ORDER BY o_orderkey LIMIT 25 OFFSET 50)""")
def grid_page(t):
    rows = filters.matching(t.orders, {"o_orderpriority": ["1-URGENT", "2-HIGH"]})
    rows = filters.containing(rows, "g", ["o_orderpriority"]).select("o_orderkey", "o_totalprice", "o_orderpriority")
    total = rows.agg(F.count(F.lit(1))).scalar()
    return ordering.page(rows, ["o_orderkey"], 3, 25).select(
        "*", total.alias("total_rows"), F.ceil(total / F.lit(25.0)).cast("bigint").alias("total_pages"))


@query("grid_page_deep", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 200 OFFSET 50000""")
def grid_page_deep(t):
    """A deep page, cut out of the distributed order instead of a top-k of offset + limit rows."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return ordering.page(t.lineitem.select(*keys), keys, 251, 200, shallow=1000).drop("l_extendedprice")
