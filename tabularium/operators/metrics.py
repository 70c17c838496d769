"""Metric definitions: aggregates, growth, and formulas over other metrics."""

from __future__ import annotations

import re
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, functions as F

from tabularium.operators import series

_AGGREGATES = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "max": F.max, "min": F.min}
_FORMULA = re.compile(r"^[A-Za-z0-9_.+\-*/() ]+$")
_NAME = re.compile(r"[A-Za-z_]\w*")


def definitions(sales=None, profit=None, cost=None, quantity=None, date=None) -> dict[str, dict]:
    """The standard metric set for the columns that are present."""
    made: dict[str, dict] = {}
    if sales:
        made["total_sales"] = {"column": sales, "aggregation": "sum"}
        made["average_sales"] = {"column": sales, "aggregation": "mean"}
        if date:
            made["monthly_sales_growth"] = {"growth_of": sales, "date": date}
        made["total_revenue"] = {"formula": "total_sales"}
    for name, column in (("total_profit", profit), ("total_cost", cost), ("total_quantity", quantity)):
        if column:
            made[name] = {"column": column, "aggregation": "sum"}
    if sales and profit:
        made["profit_margin"] = {"formula": "total_profit / total_revenue"}
        if not cost:
            made["inferred_total_cost"] = {"formula": "total_revenue - total_profit"}
    if sales and quantity:
        made["average_order_value"] = {"formula": "total_sales / total_quantity"}
    return made


def _guarded(formula: str) -> str:
    """The formula with every divisor wrapped in nullif(…, 0)."""
    if not _FORMULA.match(formula):
        raise ValueError(f"not an arithmetic formula: {formula}")
    out, i = "", 0
    while i < len(formula):
        out += formula[i]
        i += 1
        if out[-1] != "/":
            continue
        start = re.compile(r"\s*[+-]?\s*").match(formula, i).end()
        end, depth = start, 0
        while end < len(formula) and (depth or formula[end] not in "+-*/)"):
            depth += {"(": 1, ")": -1}.get(formula[end], 0)
            end += 1
        sign = "-" if "-" in formula[i:start] else ""
        out += f" nullif({sign}({_guarded(formula[start:end].strip())}), 0.0D)"
        i = end
    return out


def evaluate(df: DataFrame, wanted: dict[str, dict]) -> DataFrame:
    """``(metric, value)``, rounded to 4 decimals, null where a divisor is 0.

    All plain aggregates share one pass; formulas are expressions on that single row, in dependency order
    (a cycle raises ``graphlib.CycleError``).
    """
    base = {n: d for n, d in wanted.items() if "aggregation" in d}
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[_AGGREGATES[d["aggregation"]](F.col(d["column"]).cast("double")).alias(n) for n, d in base.items()])
    for name, d in wanted.items():
        if "growth_of" in d:
            months = series.monthly(df, d["date"], d["growth_of"])
            one = one.withColumn(name, series.last_change(months).select("change_pct").scalar())
    formulas = {n: d["formula"] for n, d in wanted.items() if "formula" in d}
    needs = {n: [m for m in _NAME.findall(f) if m in wanted] for n, f in formulas.items()}
    for name in TopologicalSorter(needs).static_order():
        if name in formulas:
            one = one.withColumn(name, F.expr(_guarded(formulas[name])))
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), (F.round(F.col(n), 4) + F.lit(0.0)).alias("value")) for n in wanted])).alias("m")
    ).select("m.*")
