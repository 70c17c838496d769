"""Read-only SQL on one table called ``dataset``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.errors import PySparkException

from tabularium.operators import stats

_READS = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)


@dataclass
class Result:
    frame: DataFrame | None
    error: str | None = None

    def facts(self, most: int | None = None) -> DataFrame:
        """One row: the row count, and whether ``most`` rows would not hold them all."""
        cut = F.lit(False) if most is None else F.col("total_rows") > most
        return self.frame.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("truncated", cut)

    def rows(self, most: int | None = None, order: list | None = None) -> DataFrame:
        """All rows, or the first ``most`` of them in the order of ``order`` (all columns unless given)."""
        return self.frame if most is None else self.frame.orderBy(*(order or self.frame.columns)).limit(most)


def run_sql(df: DataFrame, text: str) -> Result:
    """The query's plan, or the error text. Names are resolved now, rows are computed when asked for."""
    if not _READS.match(text):
        return Result(None, "only SELECT statements are allowed")
    df.createOrReplaceTempView("dataset")
    try:
        return Result(df.sparkSession.sql(text))
    except PySparkException as e:
        return Result(None, str(e).splitlines()[0])


def summary(result: Result) -> DataFrame:
    """``(column_name, detail)``: min, max, mean, sum of numbers and the top 5 values of texts of a result."""
    kept = result.frame
    numeric, texts = stats.numeric_columns(kept), stats.string_columns(kept)
    two = lambda c: F.round(c.cast("double"), 2).cast("decimal(38,2)").cast("string")
    out = None
    if numeric:
        out = stats.per_column(kept, numeric, {
            "low": lambda c: two(F.min(c)), "high": lambda c: two(F.max(c)), "mean": lambda c: two(F.avg(c)),
            "total": lambda c: two(F.sum(c))}).select("column_name", F.concat(
                F.lit("min="), "low", F.lit(", max="), "high", F.lit(", mean="), "mean", F.lit(", sum="), "total").alias("detail"))
    if texts:
        from tabularium.operators import profile
        best = profile.top_values(kept, texts, 5)
        listed = best.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct(
            "rank", F.concat("value", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("shown")))).alias("v")).select(
            "column_name", F.array_join(F.col("v.shown"), ", ").alias("detail"))
        out = listed if out is None else out.unionByName(listed)
    return out


def run_plan(df: DataFrame, questions: list[tuple[str, str]], most_questions: int | None = None, most_rows: int | None = None) -> DataFrame:
    """``(query_no, question, total_rows, truncated, error)`` per query; beyond ``most_questions`` a row says that it was not run."""
    out = None
    for number, (question, text) in enumerate(questions, 1):
        late = most_questions is not None and number > most_questions
        result = Result(None, f"not run: beyond {most_questions} questions") if late else run_sql(df, text)
        facts = result.facts(most_rows) if result.error is None else df.sparkSession.range(1).select(
            F.lit(None).cast("bigint").alias("total_rows"), F.lit(None).cast("boolean").alias("truncated"))
        one = facts.select(F.lit(number).alias("query_no"), F.lit(question).alias("question"), "total_rows", "truncated",
                           F.lit(result.error).cast("string").alias("error"))
        out = one if out is None else out.unionByName(one)
    return out
