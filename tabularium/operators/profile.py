"""Column profiles, type inference, quality score and dataset validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabularium.functions import parsing
from tabularium.operators import stats
from tabularium.session import written

# Names that may hold dates for the chat policy.
DATE_NAME = "date|time|timestamp|created|updated|dob|year|month|day"


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, stats.NUMERIC_TYPES):
        return "int"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def facts(df: DataFrame, columns: list[str] | None = None, distinct: bool = True, bounds: bool = False) -> DataFrame:
    """One row per column: dtype, rows, nulls, readable numbers and dates, and distinct values.

    Counts come from one aggregate over the whole table; distinct counts from one shuffle of partial value counts. With
    ``bounds`` a sketch in that aggregate adds ``low`` and ``high``, between which the distinct count lies.
    """
    columns = columns or df.columns
    kinds = {c: type_name(df.schema[c].dataType) for c in columns}
    c_ = lambda c: F.col(f"`{c}`")

    def numbers(c):
        if kinds[c] in ("int", "float"):
            return F.count(c_(c))
        return F.count_if(parsing.is_number(c_(c))) if kinds[c] == "string" else F.lit(0).cast("bigint")

    def dates(c):
        if kinds[c] == "datetime":
            return F.count(c_(c))
        return F.count_if(parsing.to_datetime(c_(c)).isNotNull()) if kinds[c] == "string" else F.lit(0).cast("bigint")

    value = lambda c: F.when(~F.isnan(c_(c)), c_(c)) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else c_(c)
    rows = stats.per_column(df, columns, {
        "total_rows": lambda c: F.count(F.lit(1)),
        "null_count": lambda c: F.count_if(c_(c).isNull()),
        "numbers": numbers, "dates": dates,
        **({"low": lambda c: stats.distinct_bounds(value(c))[0], "high": lambda c: stats.distinct_bounds(value(c))[1]} if bounds else {}),
    }).withColumn("dtype", F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])]), F.col("column_name")))
    if distinct:
        rows = rows.join(stats.nunique(df, columns), "column_name", "left").withColumn(
            "nunique", F.coalesce("nunique", F.lit(0)).cast("bigint"))
    present = F.col("total_rows") - F.col("null_count")
    return (rows.withColumn("number_share", F.coalesce(F.try_divide("numbers", present), F.lit(0.0)))
                .withColumn("date_share", F.coalesce(F.try_divide("dates", present), F.lit(0.0)))
                .withColumn("null_pct", F.coalesce(F.round(F.try_divide(F.col("null_count") * 100.0, "total_rows"), 2),
                                                   F.lit(0.0))))


def _of_all(count: str) -> Column:
    return F.coalesce(F.try_divide(count, "total_rows"), F.lit(0.0))


# The limits each policy uses. Every rule sees the whole column, not a sample.
POLICIES: dict[str, list[tuple[str, callable]]] = {
    "profile": [
        ("numeric", lambda: F.col("number_share") >= 0.80),
        ("datetime", lambda: F.col("date_share") >= 0.70),
        ("categorical", lambda: F.col("nunique") <= F.greatest(F.lit(10), F.floor(F.col("total_rows") * 0.05))),
    ],
    "auto_cast": [
        ("numeric", lambda: F.col("number_share") >= 0.85),
        ("datetime", lambda: F.col("date_share") >= 0.75),
    ],
    "chat": [
        ("numeric", lambda: _of_all("numbers") > 0.80),
        ("datetime", lambda: (_of_all("dates") > 0.60) & F.rlike(F.lower("column_name"), F.lit(DATE_NAME))),
        ("categorical", lambda: _of_all("nunique") < 0.10),
    ],
    "analysis": [
        ("numeric", lambda: F.col("number_share") > 0.70),
        ("datetime", lambda: F.col("date_share") > 0.50),
        ("categorical", lambda: F.col("nunique") < 10),
    ],
    "summary": [
        ("numeric", lambda: F.col("number_share") > 0.70),
        ("datetime", lambda: F.col("date_share") > 0.50),
        ("categorical", lambda: F.lit(True)),
    ],
    "grid": [
        ("numeric", lambda: _of_all("numbers") > 0.60),
        ("categorical", lambda: F.lit(True)),
    ],
    "pattern": [
        ("datetime", lambda: (F.col("dtype") == "datetime") | ((F.col("dtype") == "string") & (F.col("date_share") > 0.70))),
        ("identifier", lambda: F.col("dtype").isin("int", "string") & (_of_all("nunique") > 0.90)),
        ("numeric", lambda: F.col("dtype").isin("int", "float")),
        ("categorical", lambda: _of_all("nunique") < 0.50),
    ],
}


def inferred(policy: str) -> Column:
    """Semantic type of a facts row under a policy; text when no rule fits."""
    picked = None
    for name, rule in POLICIES[policy]:
        picked = F.when(rule(), name) if picked is None else picked.when(rule(), name)
    return picked.otherwise("text")


def infer_types(df: DataFrame, policy: str) -> DataFrame:
    """``(column_name, inferred_type)``.

    A policy's type depends on the distinct count by limits only, and each type holds an interval of it. So a column whose
    bounds give one type is decided; only columns with a limit between their bounds are counted exactly.
    """
    if policy in ("auto_cast", "summary", "grid"):
        return facts(df, distinct=False).select("column_name", inferred(policy).alias("inferred_type"))
    rows = collected(facts(df, distinct=False, bounds=True))
    kinds: dict[str, set] = {}
    for r in rows.withColumn("nunique", F.explode(F.array("low", "high"))).select("column_name", inferred(policy).alias("kind")).collect():
        kinds.setdefault(r["column_name"], set()).add(r["kind"])  # two rows per column
    open_columns = [c for c, found in kinds.items() if len(found) > 1]
    return _with_counts(df, rows, open_columns).select("column_name", inferred(policy).alias("inferred_type"))


def collected(rows: DataFrame) -> DataFrame:
    """A frame of one row per column as a local one, so that its scans are not run again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _with_counts(df: DataFrame, rows: DataFrame, exactly: list[str]) -> DataFrame:
    """``rows`` with ``nunique``: exact for some columns, the lower bound for the others."""
    if not exactly:
        return rows.withColumn("nunique", F.col("low"))
    counted = rows.join(stats.nunique(df, exactly), "column_name", "left")
    return counted.withColumn("nunique", F.when(F.col("column_name").isin(exactly), F.coalesce("nunique", F.lit(0))).otherwise(F.col("low")))


def columns(df: DataFrame) -> DataFrame:
    return facts(df).select("column_name", inferred("profile").alias("inferred_type"), "null_count", "null_pct", "nunique")


def samples(df: DataFrame, n: int = 3, names: list[str] | None = None) -> DataFrame:
    """``(column_name, samples)``: the n smallest distinct texts per column, as one text.

    The row-number limit is pushed below the shuffle, so each task sends at most n values per column.
    """
    place = F.row_number().over(W.partitionBy("column_name").orderBy("value"))
    first = stats.value_counts(df, names or df.columns).withColumn("_r", place).filter(F.col("_r") <= n)
    return first.groupBy("column_name").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("samples"))


def catalog(df: DataFrame, n: int = 6) -> DataFrame:
    """Profile rows with dtype, min, max, mean of numeric columns and sample values."""
    numeric = stats.numeric_columns(df)
    shapes = stats.per_column(df, numeric, {
        "min": lambda c: F.min(F.col(c).cast("double")), "max": lambda c: F.max(F.col(c).cast("double")),
        "mean": lambda c: F.round(F.avg(F.col(c).cast("double")), 4)}).drop("position")
    return (facts(df).withColumn("inferred_type", inferred("chat"))
            .join(shapes, "column_name", "left").join(samples(df, n), "column_name", "left")
            .select("column_name", "position", "dtype", "inferred_type", "null_count", "null_pct", "nunique",
                    "min", "max", "mean", "samples"))


def column_text(catalog_frame: DataFrame) -> DataFrame:
    """``(column_name, description)``: one line of text per catalog row."""
    return catalog_frame.select("column_name", F.concat_ws(
        " | ", F.concat(F.lit("column: "), "column_name"), F.concat(F.lit("type: "), "inferred_type"),
        F.concat(F.lit("samples: "), "samples")).alias("description"))


def report(df: DataFrame) -> DataFrame:
    """One row: rows, columns, column names by kind, and columns with missing values."""
    kinds = {c: type_name(df.schema[c].dataType) for c in df.columns}
    listed = lambda *k: F.lit(", ".join(c for c in df.columns if kinds[c] in k))
    gaps = F.array_sort(F.collect_list(F.when(F.col("null_count") > 0, F.concat_ws(
        ": ", "column_name", F.col("null_count").cast("string")))))  # one entry per column
    return stats.null_counts(df).agg(F.max("total_rows").alias("row_count"), F.array_join(gaps, ", ").alias("missing_values")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), listed("int", "float").alias("numeric_columns"),
        listed("string").alias("categorical_columns"), listed("datetime").alias("datetime_columns"), "missing_values")


def schema_rows(df: DataFrame) -> DataFrame:
    """``(name, dtype, nullable)`` with nullable meaning that a null occurs."""
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, type_name(df.schema[c].dataType))])
    return stats.null_counts(df).select(F.col("column_name").alias("name"),
                                        F.element_at(kinds, F.col("column_name")).alias("dtype"),
                                        (F.col("null_count") > 0).alias("nullable"))


def score(missing: Column, duplicate: Column, outlier: Column) -> Column:
    """0 to 100 from the three shares."""
    lost = (F.least(missing * 100 * 0.50, F.lit(30.0)) + F.least(duplicate * 100 * 1.00, F.lit(20.0))
            + F.least(outlier * 100 * 0.80, F.lit(20.0)))
    return F.greatest(F.lit(0.0), F.round(F.lit(100.0) - lost, 2))


def quality(df: DataFrame) -> DataFrame:
    """One row: score, the three shares, and the counts behind them."""
    numeric = stats.numeric_columns(df)
    if len(df.columns) <= stats.COLUMNS_PER_PASS:
        # the numbers and each row's nulls are written once; fences and counts read them
        nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0))
        slim = written(df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(numeric)], nulls.alias("nulls")), "numbers")
        beyond = stats.beyond_fences(slim, slim.columns[:-1], stage=False)
        one = slim.agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("total_nulls"),
                       sum((F.count_if(test) for test in beyond.values()), F.lit(0)).cast("bigint").alias("total_outliers"))
    else:
        beyond = stats.beyond_fences(df, numeric)
        one = stats.null_counts(df).agg(F.max("total_rows").alias("total_rows"), F.sum("null_count").alias("total_nulls"))
        cells = stats.per_column(df, list(beyond), {"n": lambda c: F.count_if(beyond[c])}) if beyond else None
        one = one.withColumn("total_outliers", cells.agg(F.sum("n")).scalar() if beyond else F.lit(0).cast("bigint"))
    one = one.withColumn("total_cols", F.lit(len(df.columns))).withColumn("total_duplicates", stats.duplicate_count(df))
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    missing = share(F.col("total_nulls"), F.col("total_rows") * F.col("total_cols"))
    duplicate = share(F.col("total_duplicates"), F.col("total_rows"))
    outlier = share(F.col("total_outliers"), F.col("total_rows") * F.lit(len(numeric)))
    return one.select(score(missing, duplicate, outlier).alias("score"), F.round(missing, 4).alias("missing_ratio"),
                      F.round(duplicate, 4).alias("duplicate_ratio"), F.round(outlier, 4).alias("outlier_ratio"),
                      "total_rows", "total_cols", "total_nulls", "total_duplicates", "total_outliers")


def live_stats(df: DataFrame) -> DataFrame:
    """Quality counts plus nulls per column and the numeric column names, as texts."""
    nulls = stats.null_counts(df).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(
        ": ", "column_name", F.col("null_count").cast("string")))), ", ")).scalar()  # one entry per column
    return quality(df).select("total_rows", "total_cols", "total_nulls", "total_duplicates", "total_outliers",
                              nulls.alias("column_nulls"), F.lit(", ".join(stats.numeric_columns(df))).alias("numeric_columns"))


# The limits a dataset must keep.
MIN_ROWS, MAX_NULL_SHARE = 10, 0.90


def validate(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """``(position, rule, passed, detail)``; the first failed rule is the one a user is told. Sizes are free unless limited."""
    names = df.columns
    if len(names) != len(set(names)):
        unique = df.toDF(*[f"c{i}" for i in range(len(names))])
    else:
        unique = df
    nulls = stats.null_counts(unique).agg(F.max("total_rows").alias("n"), F.sum("null_count").alias("nulls"))
    numeric = len(stats.numeric_columns(unique))
    share = F.coalesce(F.try_divide("nulls", F.col("n") * len(names)), F.lit(0.0))
    rules = [
        ("unique_columns", F.lit(len(names) == len(set(names))), F.lit(len(set(names))).cast("string")),
        ("min_rows", F.col("n") >= MIN_ROWS, F.col("n").cast("string")),
        ("max_rows", F.lit(True) if max_rows is None else F.col("n") <= max_rows, F.col("n").cast("string")),
        ("max_columns", F.lit(max_columns is None or len(names) <= max_columns), F.lit(len(names)).cast("string")),
        ("numeric_columns", F.lit(numeric > 0), F.lit(numeric).cast("string")),
        ("null_share", share <= MAX_NULL_SHARE, F.round(share, 4).cast("string")),
    ]
    return nulls.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("rule"), ok.alias("passed"), detail.alias("detail"))
        for i, (name, ok, detail) in enumerate(rules)])).alias("r")).select("r.*")


def first_failure(rules: DataFrame) -> DataFrame:
    return rules.filter(~F.col("passed")).orderBy("position").limit(1)


def top_values(df: DataFrame, names: list[str], n: int = 50) -> DataFrame:
    """``(column_name, rank, value, n, pct)``: most frequent values with their share of the non-null values."""
    return stats.frequent_values(df, names, n).select(
        "column_name", "rank", "value", "n", F.round(F.col("n") * 100.0 / F.col("present"), 2).alias("pct"))


def grid_stats(df: DataFrame) -> DataFrame:
    """Per column: type, and min, max, mean, count of numbers or the distinct count of categories."""
    kinds = {r["column_name"]: r["inferred_type"] for r in infer_types(df, "grid").collect()}  # one row per column
    value = lambda c: F.col(f"`{c}`").cast("double") if c in stats.numeric_columns(df) else parsing.to_number(F.col(f"`{c}`").cast("string"))
    numeric = [c for c in df.columns if kinds[c] == "numeric"]
    texts = [c for c in df.columns if kinds[c] != "numeric"]
    shown = stats.per_column(df, df.columns, {
        "min": lambda c: F.min(value(c)) if c in numeric else F.first(F.lit(None).cast("double")),
        "max": lambda c: F.max(value(c)) if c in numeric else F.first(F.lit(None).cast("double")),
        "mean": lambda c: F.round(F.avg(value(c)), 4) if c in numeric else F.first(F.lit(None).cast("double")),
        "n": lambda c: F.count(value(c)) if c in numeric else F.count(F.col(f"`{c}`")),
    }).drop("position")
    shown = shown.withColumn("kind", F.when(F.col("column_name").isin(numeric), "numeric").otherwise("categorical"))
    if not texts:
        return shown.withColumn("unique_count", F.lit(None).cast("bigint"))
    return shown.join(stats.nunique(df, texts).withColumnRenamed("nunique", "unique_count"), "column_name", "left")


def summary_cards(df: DataFrame, n: int = 5) -> DataFrame:
    """Per column: numeric avg, min, max, sum, count; categorical distinct count and its first n values."""
    numeric, texts = stats.numeric_columns(df), stats.string_columns(df)
    cards = stats.per_column(df, numeric, {
        "avg": lambda c: F.round(F.avg(F.col(c).cast("double")), 4), "min": lambda c: F.min(F.col(c).cast("double")),
        "max": lambda c: F.max(F.col(c).cast("double")),
        "sum": lambda c: F.round(F.sum(F.col(c).cast("double")), 4), "n": lambda c: F.count(F.col(c)),
    }).drop("position").withColumn("kind", F.lit("numeric"))
    if not texts:
        return cards
    words = stats.nunique(df, texts).join(samples(df, n, texts), "column_name").withColumn("kind", F.lit("categorical"))
    return cards.unionByName(words, allowMissingColumns=True)


def null_ranking(df: DataFrame, n: int = 3) -> DataFrame:
    share = F.round(F.col("null_count") * 100.0 / F.col("total_rows"), 2)
    return (stats.null_counts(df).select("column_name", "null_count", share.alias("null_pct"))
            .orderBy(F.desc("null_pct"), "column_name").limit(n))


def quick_insights(df: DataFrame) -> DataFrame:
    """``(kind, column_name, detail)``: up to 3 columns above 5 % nulls, 2 constant ones, one dominant value."""
    known = facts(df).select("*", inferred("profile").alias("inferred_type"))
    gaps = known.filter("null_pct > 5").orderBy("position").limit(3).select(
        F.lit("high_null_rate").alias("kind"), "column_name", F.round("null_pct", 1).cast("string").alias("detail"))
    flat = known.filter("nunique = 1").orderBy("position").limit(2).select(
        F.lit("constant").alias("kind"), "column_name", F.lit("1").alias("detail"))
    first = known.filter("inferred_type = 'categorical'").orderBy("position").limit(1).select("column_name")
    texts = stats.string_columns(df)
    if not texts:
        return gaps.unionByName(flat)
    best = top_values(df, texts, 1).join(first, "column_name").select(
        F.lit("dominant_value").alias("kind"), "column_name",
        F.concat("value", F.lit(" "), F.round("pct", 0).cast("int").cast("string"), F.lit("% "), F.col("n").cast("string")).alias("detail"))
    return gaps.unionByName(flat).unionByName(best)


def shape_facts(df: DataFrame) -> DataFrame:
    """Numeric columns: rows, non-null, spread (std / mean), share of positive values, std, bounds of the distinct values of
    whole numbers."""
    numeric = stats.numeric_columns(df)
    v = lambda c: F.col(f"`{c}`").cast("double")
    whole = [c for c in numeric if type_name(df.schema[c].dataType) == "int"]
    end = lambda i: lambda c: stats.distinct_bounds(F.col(f"`{c}`"))[i] if c in whole else F.first(F.lit(0).cast("bigint"))
    rows = stats.per_column(df, numeric, {
        "n": lambda c: F.count(F.lit(1)), "present": lambda c: F.count(v(c)), "mean": lambda c: F.avg(v(c)),
        "std": lambda c: F.stddev_samp(v(c)), "positive": lambda c: F.avg((v(c) > 0).cast("double")), "low": end(0), "high": end(1)})
    return (rows.withColumn("whole", F.col("column_name").isin(whole))
                .withColumn("cv", F.col("std") / (F.col("mean") + F.lit(1e-9))))


# Limits of the pattern rules.
ID_UNIQUENESS, SALES_CV, SALES_POSITIVE, MIN_VALUES = 0.9, 0.3, 0.8, 5


def identifiers(df: DataFrame) -> DataFrame:
    """``(column_name, uniqueness)`` of whole-number or text columns that are nearly unique; only those that may be are counted."""
    names = [c for c in df.columns if type_name(df.schema[c].dataType) in ("int", "string")]
    rows = collected(facts(df, names, distinct=False, bounds=True).filter(
        (F.try_divide("high", "total_rows") > ID_UNIQUENESS) & (F.col("total_rows") - F.col("null_count") >= MIN_VALUES)))
    counted = _with_counts(df, rows, [r["column_name"] for r in rows.collect()]).withColumn("uniqueness", F.try_divide("nunique", "total_rows"))
    return counted.filter(F.col("uniqueness") > ID_UNIQUENESS).select("column_name", F.round("uniqueness", 4).alias("uniqueness"))


def sales_like(df: DataFrame) -> DataFrame:
    """``(column_name, cv, positive)`` of numeric columns that look like money, in column order.

    Nearly unique whole numbers are ids; of the other rules' columns, those whose bounds leave that open are counted.
    """
    likely = collected(shape_facts(df).filter((F.col("present") >= MIN_VALUES) & (F.col("cv") > SALES_CV) & (F.col("positive") > SALES_POSITIVE)))
    unsure = (F.try_divide("high", "n") > ID_UNIQUENESS) & ~(F.try_divide("low", "n") > ID_UNIQUENESS)
    counted = _with_counts(df, likely, [r["column_name"] for r in likely.filter(F.col("whole") & unsure).collect()])
    is_id = F.col("whole") & (F.try_divide("nunique", "n") > ID_UNIQUENESS)
    return counted.filter(~is_id).select("column_name", "position", F.round("cv", 4).alias("cv"), F.round("positive", 4).alias("positive"))


def widest(df: DataFrame) -> DataFrame:
    """The numeric column with the largest standard deviation."""
    return shape_facts(df).orderBy(F.desc_nulls_last("std"), "position").limit(1).select("column_name", F.round("std", 4).alias("std"))


def outlier_candidates(df: DataFrame) -> list[str]:
    """Numeric columns worth an outlier check: not named like an id or a date part, not mostly dates."""
    import re
    named = re.compile(r"\b(id|_id|date|time|timestamp|created|updated|at|year|month|day)\b", re.IGNORECASE)
    return [c for c in stats.numeric_columns(df) if not named.search(c)]
