"""One call from a cleaned table to its validation, roles, KPIs, metrics, insights and dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabularium.functions.numbers import r4
from tabularium.operators import charts, insights, kpi, learning, match, metrics, ordering, profile, roles, series
from tabularium.plans.inputs import SALES_SQL, sales_wide
from tabularium.plans.registry import query


class Analysis:
    """The analysis of one cleaned table. Roles are found at once; every other frame is built when asked for."""

    def __init__(self, df: DataFrame, importance: DataFrame | None = None):
        self.df = df
        self.importance = importance
        self.roles = roles.detect(df)
        self.columns = {r["role"]: r["column_name"] for r in self.roles.collect()}  # at most one row per role

    def column(self, role: str) -> str | None:
        return self.columns.get(role)

    def _sales(self) -> str:
        if "sales" not in self.columns:
            raise ValueError("no column of this table can serve as sales")
        return self.columns["sales"]

    def validation(self) -> DataFrame:
        return profile.validate(self.df)

    def mode(self) -> DataFrame:
        return learning.training_mode(self.df)

    def kpis(self) -> DataFrame:
        return kpi.summary(self.df, self._sales(), self.column("profit"))

    def metrics(self) -> DataFrame:
        sales, profit, quantity, date = (self.column(r) for r in ("sales", "profit", "quantity", "date"))
        return metrics.evaluate(self.df, metrics.definitions(sales, profit, None, quantity, date))

    def insights(self) -> DataFrame:
        sales, date = self._sales(), self.column("date")
        found = insights.anomalies(self.df, sales).unionByName(insights.margin(self.metrics()))
        if not date:
            return found
        months = series.monthly(self.df, date, sales)
        return (found.unionByName(insights.trend(series.trend(months), sales))
                     .unionByName(insights.recent_change(series.last_change(months), sales)))

    def dashboard(self) -> DataFrame:
        return charts.dashboard(self.df, self.columns, self.importance)


def root_causes(df: DataFrame, date: str, sales: str, ties: list[str], categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Period comparison and its drivers for any table."""
    marked = kpi.halves(df, ordering.split_after(df, date, ties))
    compared = kpi.compare_periods(marked, sales)
    return compared, kpi.drivers(marked, categories, sales, compared)


def relevant_columns(df: DataFrame, question: str, n: int = 8) -> DataFrame:
    """``(column_name, score, rank)``: columns whose description shares words with the question."""
    described = profile.column_text(profile.catalog(df))
    order = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column_name"))
    described = described.withColumn("id", order)
    asked = df.sparkSession.createDataFrame([(0, question)], "id long, question string")
    best = match.overlapping(match.word_sets(asked, "id", "question"), match.word_sets(described, "id", "description"), n)
    names = F.array(*[F.lit(c) for c in df.columns])
    return best.select(F.element_at(names, F.col("item_id").cast("int")).alias("column_name"), F.round("score", 6).alias("score"), "rank")


WIDE = ["order_date", "sales", "quantity", "price", "product", "customer", "region", "segment", "profit"]


@query("analysis_kpis", f"""WITH {SALES_SQL} SELECT round(sum(sales), 4) AS total_sales, round(avg(sales), 4) AS average_order_value,
  round(sum(profit), 4) AS total_profit, round(sum(profit) / sum(sales) * 100, 4) AS profit_margin_percentage FROM sales_wide""")
def analysis_kpis(t):
    """KPIs of the wide table with its roles found by name."""
    one = Analysis(sales_wide(t, WIDE)).kpis()
    return one.select(*[r4(F.col(c)).alias(c) for c in one.columns])


def _by(column: str, measure: str, n: int) -> str:
    return f"SELECT substr({column}, 1, 20) AS x, round(sum({measure}), 4) AS y FROM sales_wide GROUP BY {column} ORDER BY 2 DESC, 1 LIMIT {n}"


def _board(chart_id: str, kind: str, sql: str, order: str = "y DESC, x") -> str:
    return f"SELECT '{chart_id}' AS chart_id, '{kind}' AS chart_type, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, x, y FROM ({sql})"


MONTHS = "SELECT strftime(order_date, '%Y-%m') AS x, round(sum(sales), 4) AS y FROM sales_wide GROUP BY 1 ORDER BY 1 DESC LIMIT 30"


@query("dashboard_fallbacks", f"WITH {SALES_SQL} " + " UNION ALL ".join([
    _board("trend_line", "line", MONTHS, "x"), _board("revenue_area", "area", MONTHS, "x"),
    _board("customer_bar", "bar", _by("segment", "sales", 8)), _board("qty_bar", "bar", _by("segment", "quantity", 10)),
    _board("secondary_metric_bar", "bar", _by("segment", "quantity", 10)),
    _board("extra_quantity", "bar", _by("segment", "quantity", 10)), _board("extra_price", "bar", _by("segment", "price", 10))]))
def dashboard_fallbacks(t):
    """Dashboard of a table without product, customer, region and profit columns."""
    wide = sales_wide(t, ["order_date", "sales", "quantity", "price", "segment", "product"]).withColumnRenamed("product", "brand")
    return charts.dashboard(wide, {"date": "order_date", "sales": "sales", "quantity": "quantity"})


@query("chat_columns")
def chat_columns(t):
    """Columns of the part table that fit a question. No SQL: the texts describe columns (metadata)."""
    return relevant_columns(t.part, "Which numeric column and which brand type sells best?", 4)
