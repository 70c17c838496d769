"""Registered profile, type, role, matching and scalar-function queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tabularium.functions import dates, nested, text
from tabularium.functions.numbers import r4
from tabularium.functions.parsing import DATE_FORMATS_SQL, NUMBER, is_number
from tabularium.operators import match, profile, roles, stats
from tabularium.plans.inputs import DIRTY_COLUMNS, DIRTY_SQL, SALES_SQL, dirty_lineitem, sales_wide
from tabularium.plans.registry import query

DIRTY_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "quantity", "price", "discount"]


def _facts_sql() -> str:
    """One row per column of the dirty table: n, nulls, numbers, dates, nunique."""
    parts = []
    for i, c in enumerate(DIRTY_COLUMNS):
        numeric = c in DIRTY_NUMERIC
        numbers = f"count({c})" if numeric else f"count(*) FILTER (regexp_matches(trim({c}), '{NUMBER}'))"
        dates = "0" if numeric else f"count(*) FILTER (try_strptime(trim({c}), {DATE_FORMATS_SQL}) IS NOT NULL)"
        parts.append(f"SELECT '{c}' AS column_name, {i + 1} AS position, count(*) AS n, count(*) - count({c}) AS nulls, "
                     f"{numbers} AS numbers, {dates} AS dates, count(DISTINCT {c}) AS nunique FROM dirty")
    return " UNION ALL ".join(parts)


FACTS_SQL = f"{DIRTY_SQL}, facts AS (SELECT *, numbers / (n - nulls) AS ns, dates / (n - nulls) AS ds FROM ({_facts_sql()}))"
PROFILE_TYPE = """CASE WHEN ns >= 0.8 THEN 'numeric' WHEN ds >= 0.7 THEN 'datetime'
  WHEN nunique <= greatest(10, floor(n * 0.05)) THEN 'categorical' ELSE 'text' END"""


@query("profile_columns", f"""WITH {FACTS_SQL}
SELECT column_name, {PROFILE_TYPE} AS inferred_type, nulls AS null_count, round(nulls * 100.0 / n, 2) AS null_pct, nunique
FROM facts""")
def profile_columns(t):
    return profile.columns(dirty_lineitem(t))


def _infer(policy: str, case: str):
    @query(f"infer_types_{policy}", f"WITH {FACTS_SQL} SELECT column_name, {case} AS inferred_type FROM facts")
    def run(t):
        return profile.infer_types(dirty_lineitem(t), policy)
    return run


DIRTY_WHOLE = "('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber')"
for _policy, _case in {
    "profile": PROFILE_TYPE,
    "auto_cast": "CASE WHEN ns >= 0.85 THEN 'numeric' WHEN ds >= 0.75 THEN 'datetime' ELSE 'text' END",
    "chat": """CASE WHEN numbers / n > 0.8 THEN 'numeric'
      WHEN dates / n > 0.6 AND regexp_matches(column_name, 'date|time|timestamp|created|updated|dob|year|month|day') THEN 'datetime'
      WHEN nunique / n < 0.1 THEN 'categorical' ELSE 'text' END""",
    "analysis": "CASE WHEN ns > 0.7 THEN 'numeric' WHEN ds > 0.5 THEN 'datetime' WHEN nunique < 10 THEN 'categorical' ELSE 'text' END",
    "summary": "CASE WHEN ns > 0.7 THEN 'numeric' WHEN ds > 0.5 THEN 'datetime' ELSE 'categorical' END",
    "grid": "CASE WHEN numbers / n > 0.6 THEN 'numeric' ELSE 'categorical' END",
    "pattern": f"""CASE WHEN column_name NOT IN ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'quantity', 'price', 'discount')
      AND ds > 0.7 THEN 'datetime'
      WHEN column_name NOT IN ('quantity', 'price', 'discount') AND nunique / n > 0.9 THEN 'identifier'
      WHEN column_name IN ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'quantity', 'price', 'discount') THEN 'numeric'
      WHEN nunique / n < 0.5 THEN 'categorical' ELSE 'text' END""",
}.items():
    _infer(_policy, _case)


PART_TYPES = {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float"}


def _catalog_sql() -> str:
    parts = []
    for i, (c, dtype) in enumerate(PART_TYPES.items()):
        shape = (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean"
                 if dtype != "string" else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean")
        parts.append(f"""SELECT '{c}' AS column_name, CAST({i + 1} AS INTEGER) AS position, '{dtype}' AS dtype,
  {"'numeric'" if dtype != "string" else f"CASE WHEN count(DISTINCT {c}) / count(*) < 0.1 THEN 'categorical' ELSE 'text' END"} AS inferred_type,
  count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct,
  count(DISTINCT {c}) AS nunique, {shape}, (SELECT string_agg(v, ', ' ORDER BY v) FROM (
    SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM part WHERE {c} IS NOT NULL ORDER BY v LIMIT 6)) AS samples FROM part""")
    return " UNION ALL ".join(parts)


@query("profile_catalog", _catalog_sql())
def profile_catalog(t):
    return profile.catalog(t.part)


@query("fn_column_text", f"""SELECT column_name, 'column: ' || column_name || ' | type: ' || inferred_type || ' | samples: ' || samples
  AS description FROM ({_catalog_sql()})""")
def fn_column_text(t):
    return profile.column_text(profile.catalog(t.part))


@query("profile_samples", """SELECT 'p_brand' AS column_name, (SELECT string_agg(v, ', ' ORDER BY v) FROM (
    SELECT DISTINCT p_brand AS v FROM part ORDER BY v LIMIT 3)) AS samples
UNION ALL SELECT 'p_type', (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT p_type AS v FROM part ORDER BY v LIMIT 3))
UNION ALL SELECT 'p_name', (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT p_name AS v FROM part ORDER BY v LIMIT 3))""")
def profile_samples(t):
    return profile.samples(t.part, 3, ["p_brand", "p_type", "p_name"])


MISSING_SQL = f"""SELECT string_agg(column_name || ': ' || nulls, ', ' ORDER BY column_name || ': ' || nulls) FROM ({_facts_sql()})
  WHERE nulls > 0"""


@query("profile_report", f"""WITH {DIRTY_SQL}
SELECT count(*) AS row_count, CAST(12 AS INTEGER) AS column_count,
  'l_orderkey, l_partkey, l_suppkey, l_linenumber, quantity, price, discount' AS numeric_columns,
  'flag, note, qty_text, date_text, currency' AS categorical_columns, '' AS datetime_columns,
  ({MISSING_SQL}) AS missing_values FROM dirty""")
def profile_report(t):
    return profile.report(dirty_lineitem(t))


@query("schema_emit", f"""WITH {DIRTY_SQL} SELECT column_name AS name, CASE WHEN column_name IN ('l_orderkey', 'l_partkey',
  'l_suppkey', 'l_linenumber') THEN 'int' WHEN column_name IN ('quantity', 'price', 'discount') THEN 'float' ELSE 'string' END
  AS dtype, nulls > 0 AS nullable FROM ({_facts_sql()})""")
def schema_emit(t):
    return profile.schema_rows(dirty_lineitem(t))


def _outliers_sql() -> str:
    parts = [f"""SELECT '{c}' AS column_name, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound,
  (SELECT count(*) FROM dirty WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty)""" for c in DIRTY_NUMERIC]
    return " UNION ALL ".join(parts)


QUALITY_SQL = f"""{DIRTY_SQL}, q AS (SELECT (SELECT count(*) FROM dirty) AS n, (SELECT sum(nulls) FROM ({_facts_sql()})) AS nulls,
  (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS dups,
  (SELECT sum(outliers) FROM ({_outliers_sql()})) AS outs),
shares AS (SELECT *, nulls / (n * 12) AS m, dups / n AS d, outs / (n * 7) AS o FROM q)"""


@query("quality_score", f"""WITH {QUALITY_SQL} SELECT greatest(0.0, round(100.0 - (least(m * 100 * 0.5, 30.0) +
  least(d * 100 * 1.0, 20.0) + least(o * 100 * 0.8, 20.0)), 2)) AS score, round(m, 4) AS missing_ratio,
  round(d, 4) AS duplicate_ratio, round(o, 4) AS outlier_ratio, CAST(n AS BIGINT) AS total_rows,
  CAST(12 AS INTEGER) AS total_cols, CAST(nulls AS BIGINT) AS total_nulls, CAST(dups AS BIGINT) AS total_duplicates,
  CAST(outs AS BIGINT) AS total_outliers FROM shares""")
def quality_score(t):
    return profile.quality(dirty_lineitem(t))


@query("dataset_stats", f"""WITH {QUALITY_SQL} SELECT CAST(n AS BIGINT) AS total_rows, CAST(12 AS INTEGER) AS total_cols,
  CAST(nulls AS BIGINT) AS total_nulls, CAST(dups AS BIGINT) AS total_duplicates, CAST(outs AS BIGINT) AS total_outliers,
  (SELECT string_agg(column_name || ': ' || nulls, ', ' ORDER BY column_name || ': ' || nulls) FROM ({_facts_sql()})) AS column_nulls,
  '{', '.join(DIRTY_NUMERIC)}' AS numeric_columns FROM shares""")
def dataset_stats(t):
    return profile.live_stats(dirty_lineitem(t))


@query("outlier_counts", f"""WITH {DIRTY_SQL} SELECT column_name, round(lower_bound, 4) AS lower_bound,
  round(upper_bound, 4) AS upper_bound, outliers FROM ({_outliers_sql()})""")
def outlier_counts(t):
    cells = stats.outlier_cells(dirty_lineitem(t))
    return cells.select("column_name", r4(F.col("lower_bound")).alias("lower_bound"),
                        r4(F.col("upper_bound")).alias("upper_bound"), "outliers")


@query("validate_dataset", f"""WITH {DIRTY_SQL}, s AS (SELECT (SELECT count(*) FROM dirty) AS n, (SELECT sum(nulls) FROM ({_facts_sql()})) AS nulls)
SELECT CAST(1 AS INTEGER) AS position, 'unique_columns' AS rule, true AS passed, '12' AS detail
UNION ALL SELECT 2, 'min_rows', n >= 10, CAST(n AS VARCHAR) FROM s
UNION ALL SELECT 3, 'max_rows', n <= 5000000, CAST(n AS VARCHAR) FROM s
UNION ALL SELECT 4, 'max_columns', true, '12' UNION ALL SELECT 5, 'numeric_columns', true, '7'
UNION ALL SELECT 6, 'null_share', nulls / (n * 12) <= 0.9, CAST(round(nulls / (n * 12), 4) AS VARCHAR) FROM s""")
def validate_dataset(t):
    return profile.validate(dirty_lineitem(t))


def _top_sql(columns: list[str], table: str, n: int) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM {table} WHERE {c} IS NOT NULL" for c in columns)
    return f"""SELECT column_name, rank, value, n, pct FROM (SELECT column_name, value, count(*) AS n,
  CAST(row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS INTEGER) AS rank,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY column_name), 2) AS pct FROM ({long}) GROUP BY 1, 2) WHERE rank <= {n}"""


@query("profile_top_values", f"WITH {DIRTY_SQL} {_top_sql(['flag', 'note', 'qty_text', 'date_text', 'currency'], 'dirty', 50)}")
def profile_top_values(t):
    return profile.top_values(dirty_lineitem(t), ["flag", "note", "qty_text", "date_text", "currency"])


@query("profile_grid_stats", f"""WITH {DIRTY_SQL} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'numeric' AS kind, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"round(avg({c}), 4) AS mean, count({c}) AS n, CAST(NULL AS BIGINT) AS unique_count FROM dirty" for c in DIRTY_NUMERIC)
    + """ UNION ALL SELECT 'qty_text', 'numeric', min(v), max(v), round(avg(v), 4), count(v), NULL FROM (
  SELECT CASE WHEN qty_text <> 'n/a' THEN CAST(qty_text AS DOUBLE) END AS v FROM dirty) UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', 'categorical', NULL, NULL, NULL, count({c}), count(DISTINCT {c}) FROM dirty" for c in ("flag", "note", "date_text", "currency")))
def profile_grid_stats(t):
    return profile.grid_stats(dirty_lineitem(t))


@query("analytics_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'numeric' AS kind, round(avg({c}), 4) AS avg, CAST(min({c}) AS DOUBLE) AS min, "
    f"CAST(max({c}) AS DOUBLE) AS max, round(CAST(sum({c}) AS DOUBLE), 4) AS sum, count({c}) AS n, CAST(NULL AS BIGINT) AS nunique, "
    f"CAST(NULL AS VARCHAR) AS samples FROM part" for c in ("p_partkey", "p_size", "p_retailprice")) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', 'categorical', NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}), (SELECT string_agg(v, ', ' ORDER BY v) FROM ("
    f"SELECT DISTINCT {c} AS v FROM part ORDER BY v LIMIT 5)) FROM part" for c in ("p_name", "p_brand", "p_type")))
def analytics_summary(t):
    return profile.summary_cards(t.part)


@query("null_ranking", f"""WITH {DIRTY_SQL} SELECT column_name, nulls AS null_count, round(nulls * 100.0 / n, 2) AS null_pct
FROM ({_facts_sql()}) ORDER BY 3 DESC, 1 LIMIT 3""")
def null_ranking(t):
    return profile.null_ranking(dirty_lineitem(t))


@query("quick_insights", f"""WITH {FACTS_SQL}, typed AS (SELECT *, {PROFILE_TYPE} AS kind, round(nulls * 100.0 / n, 2) AS pct FROM facts),
top AS ({_top_sql(['flag', 'note', 'qty_text', 'date_text', 'currency'], 'dirty', 1)})
SELECT 'high_null_rate' AS kind, column_name, CAST(round(pct, 1) AS VARCHAR) AS detail FROM (
  SELECT * FROM typed WHERE pct > 5 ORDER BY position LIMIT 3)
UNION ALL SELECT 'constant', column_name, '1' FROM (SELECT * FROM typed WHERE nunique = 1 ORDER BY position LIMIT 2)
UNION ALL SELECT 'dominant_value', column_name, top.value || ' ' || CAST(round(top.pct, 0) AS INTEGER) || '% ' || top.n
FROM top JOIN (SELECT column_name FROM typed WHERE kind = 'categorical' ORDER BY position LIMIT 1) USING (column_name)""")
def quick_insights(t):
    return profile.quick_insights(dirty_lineitem(t))


@query("detect_identifiers", """SELECT 'o_orderkey' AS column_name, round(count(DISTINCT o_orderkey) / count(*), 4) AS uniqueness FROM orders""")
def detect_identifiers(t):
    return profile.identifiers(t.orders)


@query("detect_sales_column", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position,
  round(cv, 4) AS cv, round(positive, 4) AS positive FROM (SELECT stddev_samp({c}) / (avg({c}) + 1e-9) AS cv,
  avg(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END) AS positive, count(DISTINCT {c}) / count(*) AS u FROM orders)
  WHERE cv > 0.3 AND positive > 0.8 AND NOT ({whole} AND u > 0.9)""" for i, (c, whole) in enumerate(
    (("o_orderkey", "true"), ("o_custkey", "true"), ("o_totalprice", "false")), 1)))
def detect_sales_column(t):
    return profile.sales_like(t.orders)


@query("detect_fallback_sales", """SELECT column_name, round(s, 4) AS std FROM (
  SELECT 'o_orderkey' AS column_name, stddev_samp(o_orderkey) AS s FROM orders
  UNION ALL SELECT 'o_custkey', stddev_samp(o_custkey) FROM orders
  UNION ALL SELECT 'o_totalprice', stddev_samp(o_totalprice) FROM orders) ORDER BY s DESC LIMIT 1""")
def detect_fallback_sales(t):
    return profile.widest(t.orders)


OFFERED = ("sales", "quantity", "price", "profit")


@query("prj_outlier_columns", f"WITH {SALES_SQL}, f AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in OFFERED) + " FROM sales_wide) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} < {c}_1 - 1.5 * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5 * ({c}_3 - {c}_1)) AS outliers
FROM sales_wide, f""" for c in OFFERED))
def prj_outlier_columns(t):
    """Outlier counts of the columns a user would be offered."""
    wide = sales_wide(t, ["order_date", "sales", "quantity", "price", "profit"])
    return stats.outlier_cells(wide, profile.outlier_candidates(wide)).select("column_name", "outliers")


# ---- statistics ----------------------------------------------------------------------------------------

STAT_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


@query("stat_quantiles", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.25), 4) + 0.0 AS q1,
  round(quantile_cont({c}, 0.5), 4) + 0.0 AS median, round(quantile_cont({c}, 0.75), 4) + 0.0 AS q3 FROM lineitem""" for c in STAT_COLUMNS))
def stat_quantiles(t):
    found = stats.quantiles(t.lineitem, list(STAT_COLUMNS), [0.25, 0.5, 0.75])
    rows = [(c, *[round(v, 4) + 0.0 for v in qs]) for c, qs in found.items()]
    return t.spark.createDataFrame(rows, "column_name string, q1 double, median double, q3 double")


@query("stat_quantiles_zoom", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.01), 4) + 0.0 AS p01,
  round(quantile_cont({c}, 0.99), 4) + 0.0 AS p99 FROM lineitem""" for c in STAT_COLUMNS))
def stat_quantiles_zoom(t):
    """The large-table way to the same exact quantiles: histograms that zoom in on each rank."""
    found = stats.quantiles(t.lineitem, list(STAT_COLUMNS), [0.01, 0.99])
    rows = [(c, *[round(v, 4) + 0.0 for v in qs]) for c, qs in found.items()]
    return t.spark.createDataFrame(rows, "column_name string, p01 double, p99 double")


@query("stat_spread", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(stddev_pop({c}), 6) AS std_pop FROM lineitem""" for c in STAT_COLUMNS))
def stat_spread(t):
    return stats.per_column(t.lineitem, list(STAT_COLUMNS), {
        "mean": lambda c: F.round(F.avg(c), 6), "std": lambda c: F.round(F.stddev_samp(c), 6),
        "std_pop": lambda c: F.round(F.stddev_pop(c), 6)}).drop("position")


@query("stat_mode", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, mode, n FROM (SELECT {c} AS mode, count(*) AS n
  FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""" for c in ("p_name", "p_brand", "p_type")))
def stat_mode(t):
    return stats.modes(t.part, ["p_name", "p_brand", "p_type"])


# ---- matching ------------------------------------------------------------------------------------------

# Header-like texts made from the rows: exact words, words in other spelling, near misses and strangers.
HEADERS = ("Order Date", "unit-price", " Qty", "Region", "SKU", "revenu", "custmer name", "quantitty", "Net Proffit", "shelf")
HEADER_SQL = "headers AS (SELECT DISTINCT (['" + "', '".join(HEADERS) + "'])[1 + p_partkey % 10] AS header FROM part)"


def _headers(t):
    names = F.array(*[F.lit(h) for h in HEADERS])
    return t.part.select(F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int")).alias("header"))


def _words_sql() -> str:
    rows = ", ".join(f"({n}, '{role}', '{w}')" for n, (role, ws) in enumerate(match.ROLE_WORDS.items()) for w in ws)
    return f"words AS (SELECT * FROM (VALUES {rows}) AS v(place, role, word))"


NORM_SQL = "translate(lower(trim(header)), ' -', '__')"


@query("dict_match_exact", f"""WITH {HEADER_SQL}, {_words_sql()}, one AS (
  SELECT word, role FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY place) AS r FROM words) WHERE r = 1)
SELECT (['{"', '".join(HEADERS)}'])[1 + p_partkey % 10] AS header, role, count(*) AS parts
FROM part LEFT JOIN one ON word = translate(lower(trim((['{"', '".join(HEADERS)}'])[1 + p_partkey % 10])), ' -', '__') GROUP BY 1, 2""")
def dict_match_exact(t):
    return match.match_exact(_headers(t), "header").groupBy("header", "role").agg(F.count(F.lit(1)).alias("parts"))


@query("dict_match_fuzzy", f"""WITH {HEADER_SQL}, {_words_sql()}, n AS (SELECT header, {NORM_SQL} AS norm FROM headers),
s AS (SELECT header, norm, role, place, word = norm AS same, 100.0 * (1.0 - levenshtein(norm, word) / greatest(length(norm), length(word))) AS score
  FROM n, words),
b AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY score DESC, place, role DESC) AS r FROM s)
SELECT header, norm, CASE WHEN same OR (score >= 80 AND length(norm) > 3) THEN role END AS role,
  CASE WHEN same THEN 'dict' WHEN score >= 80 AND length(norm) > 3 THEN 'fuzzy' END AS method,
  CASE WHEN same THEN 100.0 WHEN score >= 80 AND length(norm) > 3 THEN round(score, 4) END AS score FROM b WHERE r = 1""")
def dict_match_fuzzy(t):
    return match.match_names(_headers(t), "header")


ROLE_COLUMNS = ("order_date", "net sales", "qtty", "Unit-Price", "product", "customer", "region", "segment", "profit")


@query("detect_roles", f"""WITH cols AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(ROLE_COLUMNS))}) AS v(position, header)
  WHERE EXISTS (FROM lineitem)), {_words_sql()},
n AS (SELECT position, header, {NORM_SQL} AS norm FROM cols),
s AS (SELECT position, header, role, place, word = norm AS same, length(norm) > 3 AS long_enough,
  100.0 * (1.0 - levenshtein(norm, word) / greatest(length(norm), length(word))) AS score FROM n, words),
b AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY same DESC, score DESC, place, role DESC) AS r FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, position) AS k FROM b WHERE r = 1 AND (same OR (score >= 80 AND long_enough)))
SELECT role, header AS column_name, CASE WHEN same THEN 'dict' ELSE 'fuzzy' END AS method,
  CASE WHEN same THEN 1.0::DOUBLE ELSE score / 100 END AS confidence FROM m WHERE k = 1""")
def detect_roles(t):
    """Roles of the wide sales columns, two of which have odd names."""
    wide = sales_wide(t, ["order_date", "sales", "quantity", "price", "product", "customer", "region", "segment", "profit"])
    return roles.detect(wide.toDF(*ROLE_COLUMNS))


def _shape_sql(number: int, columns: list[tuple]) -> str:
    """The sales column that the data rules find among unnamed numeric columns (name, expression, whole)."""
    facts = " UNION ALL ".join(f"""SELECT {i} AS position, '{c}' AS column_name, stddev_samp({x}) AS s, stddev_samp({x}) / (avg({x}) + 1e-9) AS cv,
  avg(CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END) AS positive, {whole} AND count(DISTINCT {x}) / count(*) > 0.9 AS is_id FROM orders"""
                               for i, (c, x, whole) in enumerate(columns))
    return f"""f{number} AS ({facts}), s{number} AS (SELECT column_name FROM f{number} WHERE cv > 0.3 AND positive > 0.8 AND NOT is_id ORDER BY position LIMIT 1),
w{number} AS (SELECT column_name FROM f{number} WHERE NOT EXISTS (FROM s{number}) ORDER BY s DESC, position LIMIT 1)"""


@query("detect_roles_unnamed", f"""WITH {_shape_sql(1, [('q1', 'o_orderkey', 'true'), ('q3', 'o_totalprice', 'false'), ('q4', 'o_custkey', 'true')])},
{_shape_sql(2, [('q1', 'o_orderkey', 'true'), ('q2', '(-o_totalprice)', 'false')])},
d AS (SELECT avg(CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 1.0 END) AS share FROM orders)
SELECT 1 AS table_no, 'sales' AS role, column_name, 'pattern' AS method, CAST(0.6 AS DOUBLE) AS confidence FROM s1
UNION ALL SELECT 1, 'sales', column_name, 'fallback', 0.4 FROM w1 UNION ALL SELECT 1, 'date', 'q2', 'fallback', 0.35 FROM d WHERE share > 0.7
UNION ALL SELECT 2, 'sales', column_name, 'pattern', 0.6 FROM s2 UNION ALL SELECT 2, 'sales', column_name, 'fallback', 0.4 FROM w2
UNION ALL SELECT 2, 'date', 'q3', 'pattern', 0.6 FROM d""")
def detect_roles_unnamed(t):
    """Roles of two tables whose names say nothing: texts that are mostly dates, real dates, money among ids, and no money at all."""
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    one = t.orders.select(F.col("o_orderkey").alias("q1"), text.alias("q2"), F.col("o_totalprice").alias("q3"), F.col("o_custkey").alias("q4"), F.col("o_orderpriority").alias("q5"))
    two = t.orders.select(F.col("o_orderkey").alias("q1"), (-F.col("o_totalprice")).alias("q2"), F.col("o_orderdate").alias("q3"))
    found = [roles.detect(df).select(F.lit(i).alias("table_no"), "*") for i, df in ((1, one), (2, two))]
    return found[0].unionByName(found[1])


@query("vec_topk", """WITH v AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, generate_series(1, 64) AS g(i)),
c AS (SELECT label, i, avg(x) AS x FROM v GROUP BY 1, 2),
cn AS (SELECT label, i, x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-10) AS x FROM c),
vn AS (SELECT vec_id, i, x / (sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 1e-10) AS x FROM v),
s AS (SELECT cn.label AS query_id, vn.vec_id AS item_id, sum(cn.x * vn.x) AS score FROM cn JOIN vn USING (i) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank,
  max(score) OVER (PARTITION BY query_id) AS top FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r
WHERE (score >= 0.25 AND rank <= 8) OR (top < 0.25 AND rank <= 3)""")
def vec_topk(t):
    """Per label: the vectors closest to the label's mean vector."""
    means = t.embeddings.groupBy("label").agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    questions = means.select(F.col("label").cast("bigint"), vector_to_array("m"))
    found = match.nearest(questions, t.embeddings.select("vec_id", "embedding"))
    return found.withColumn("score", F.round("score", 6))


@query("vec_neighbours", """WITH v AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, generate_series(1, 64) AS g(i)),
vn AS (SELECT vec_id, list(x / (n + 1e-10) ORDER BY i) AS u FROM (
  SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM v) GROUP BY 1),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_dot_product(a.u, b.u) AS score FROM vn a, vn b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s)
SELECT query_id, item_id, round(score, 6) AS score FROM r WHERE rank <= 4""")
def vec_neighbours(t):
    """The four nearest of all vectors for a stated set of queries: the vectors whose id is divisible by 50."""
    vectors = t.embeddings.select("vec_id", "embedding")
    found = match.nearest(vectors.filter("vec_id % 50 = 0"), vectors, k=4, least=-1.0, otherwise=1)
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"))


@query("vec_normalize", """SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS squared, round(u[1], 6) AS first
FROM (SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-10)) AS u
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def vec_normalize(t):
    unit = t.embeddings.select("vec_id", nested.l2_normalise(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(nested.dot(F.col("u"), F.col("u")), 6).alias("squared"),
                       F.round(F.element_at("u", 1), 6).alias("first"))


TOKENS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2))"


@query("tok_jaccard_topk", f"""WITH q AS (SELECT item_id AS query_id, unnest(w) AS w, len(w) AS ql FROM (
  SELECT item_id, {TOKENS_SQL} AS w FROM benchmark)),
d AS (SELECT doc_id AS item_id, unnest(w) AS w, len(w) AS dl FROM (SELECT doc_id, {TOKENS_SQL} AS w FROM documents)),
s AS (SELECT query_id, item_id, count(*) / (any_value(ql) + any_value(dl) - count(*) + 1e-10) AS score FROM q JOIN d USING (w) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)
SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def tok_jaccard_topk(t):
    found = match.overlapping(match.word_sets(t.benchmark, "item_id", "text"), match.word_sets(t.documents, "doc_id", "text"))
    return found.withColumn("score", F.round("score", 6))


# ---- scalar functions ----------------------------------------------------------------------------------

@query("fn_normalise_name", "SELECT p_partkey, translate(lower(trim(' ' || p_name || '-' || p_type)), ' -', '__') AS name FROM part")
def fn_normalise_name(t):
    raw = F.concat(F.lit(" "), "p_name", F.lit("-"), "p_type")
    return t.part.select("p_partkey", text.normalise_name(raw).alias("name"))


@query("fn_slug", """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' (' || p_name || ')'), '[^a-z0-9]+', '_', 'g'),
  '^_|_$', '', 'g') AS slug FROM part""")
def fn_slug(t):
    return t.part.select("p_partkey", text.slug(F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))).alias("slug"))


@query("fn_sanitize_filename", """WITH b AS (SELECT page_id, u, regexp_replace(u, '^.*/', '') AS base FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '.HTML' WHEN page_id % 3 = 1 THEN '' ELSE url END AS u FROM pages)),
e AS (SELECT page_id, u, base, lower(regexp_extract(base, '^.+([.][^.]+)$', 1)) AS ext FROM b),
s AS (SELECT page_id, u, ext, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(
  CASE WHEN ext <> '' THEN regexp_replace(base, '[.][^.]+$', '') ELSE u END, '[^a-zA-Z0-9._-]', '_', 'g'), '[.]+', '.', 'g'),
  '_+', '_', 'g'), 1, 30), '[._]+$', '') AS stem FROM e)
SELECT page_id, CASE WHEN u = '' THEN 'unnamed_dataset' ELSE (CASE WHEN stem = '' THEN 'dataset' ELSE stem END) ||
  (CASE WHEN ext = '' THEN '.csv' ELSE ext END) END AS file_name FROM s""")
def fn_sanitize_filename(t):
    n = F.col("page_id") % 3
    named = F.when(n == 0, F.concat("url", F.lit(".HTML"))).when(n == 1, F.lit("")).otherwise(F.col("url"))
    return t.pages.select("page_id", text.sanitize_filename(named).alias("file_name"))


@query("fn_mask_email", r"""SELECT doc_id, regexp_replace(text, '([\w.-]{2})[\w.-]+@([\w.-]+)', '\1***@\2', 'g') AS masked FROM documents""")
def fn_mask_email(t):
    return t.documents.select("doc_id", text.mask_email(F.col("text")).alias("masked"))


@query("fn_is_numeric", f"""WITH {DIRTY_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  regexp_matches(replace(trim(qty_text || ',000'), ',', ''), '{NUMBER}') AS numeric FROM dirty""")
def fn_is_numeric(t):
    return dirty_lineitem(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                    is_number(F.concat("qty_text", F.lit(",000")), commas=True).alias("numeric"))


@query("fn_tokenize", """SELECT doc_id AS id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
  lambda w: length(w) >= 2), ' ') AS words FROM documents""")
def fn_tokenize(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.array_join(text.tokens(F.col("text")), " ").alias("words"))


@query("fn_user_label", """SELECT c_custkey, split_part(lower(replace(c_name, '#', '.')) || '@example.com', '@', 1) AS label,
  upper(substr(c_mktsegment, 1, 1)) || upper(substr(c_name, 1, 1)) AS initials FROM customer""")
def fn_user_label(t):
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    return t.customer.select("c_custkey", text.user_label(mail).alias("label"),
                             text.initials(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("initials"))


@query("fn_format_size", """SELECT doc_id, CASE WHEN b = 0 THEN '0 B' WHEN b / 1048576.0 >= 1
  THEN CAST(CAST(round(b / 1048576.0, 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' MB'
  ELSE CAST(CAST(round(b / 1024.0, 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' KB' END AS size
FROM (SELECT doc_id, n_chars * 997 AS b FROM documents)""")
def fn_format_size(t):
    return t.documents.select("doc_id", text.format_size(F.col("n_chars") * 997).alias("size"))


@query("fn_format_duration", """SELECT event_id, CASE WHEN s = 0 THEN '0s' WHEN s < 60 THEN s || 's'
  WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END AS duration
FROM (SELECT event_id, CAST(floor(value * 40) AS BIGINT) AS s FROM events)""")
def fn_format_duration(t):
    return t.events.select("event_id", text.format_duration(F.floor(F.col("value") * 40).cast("bigint")).alias("duration"))


@query("fn_date_labels", """SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%a') AS weekday
FROM events""")
def fn_date_labels(t):
    return t.events.select("event_id", dates.month_label("ts").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
                           dates.weekday_label("ts").alias("weekday"))


@query("fn_json_get", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json_get(t):
    return t.events.select("event_id", nested.json_get(F.col("props"), "k").alias("k"))


@query("fn_json_merge", """SELECT event_id, '{"k":"' || CASE WHEN event_type = 'error' THEN 'masked'
  ELSE json_extract_string(props, '$.k') END || '","type":"' || event_type || '"}' AS merged FROM events""")
def fn_json_merge(t):
    patch = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.col("event_type").alias("type"), F.lit("masked").alias("k")))) \
        .otherwise(F.to_json(F.struct(F.col("event_type").alias("type"))))
    return t.events.select("event_id", nested.json_merge(F.col("props"), patch).alias("merged"))


@query("fn_json_records", """SELECT n_regionkey, '[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ','
  ORDER BY n_nationkey) || ']' AS records FROM nation GROUP BY 1""")
def fn_json_records(t):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    return t.nation.groupBy("n_regionkey").agg(F.to_json(rows).alias("records"))


@query("fn_uuid_check", f"""SELECT event_id, regexp_matches(u, '{text.UUID}') AS ok FROM (SELECT event_id,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) ||
  CASE WHEN event_type = 'error' THEN '' ELSE '-' END || substr(h, 21, 12) AS u
  FROM (SELECT event_id, event_type, md5(CAST(event_id AS VARCHAR)) AS h FROM events))""")
def fn_uuid_check(t):
    h = F.md5(F.col("event_id").cast("string"))
    last = F.when(F.col("event_type") == "error", "").otherwise("-")
    made = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"),
                    F.substring(h, 17, 4), last, F.substring(h, 21, 12))
    return t.events.select("event_id", text.is_uuid(made).alias("ok"))


QUESTION_SQL = """questions AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Show top ' || p_size || ' ' || p_type
  WHEN 1 THEN 'why did ' || p_brand || ' drop' WHEN 2 THEN 'help with ' || p_name
  WHEN 3 THEN 'Compare trend of ' || p_type ELSE p_name || ' please' END AS q FROM part)"""


def _pattern(words) -> str:
    return text.word_pattern(words).replace("'", "''")


@query("txt_intent_label", rf"""WITH {QUESTION_SQL} SELECT p_partkey, q AS question,
  CASE WHEN length(trim(q)) < 30 AND regexp_matches(lower(q), '{_pattern(text.GENERAL_WORDS)}') THEN 'general'
  WHEN regexp_matches(lower(q), '{_pattern(text.ANALYTICAL_WORDS)}') THEN 'analytical'
  WHEN regexp_matches(lower(q), '{_pattern(text.DATA_WORDS)}') THEN 'data_query' ELSE 'ambiguous' END AS label FROM questions""")
def txt_intent_label(t):
    n = F.col("p_partkey") % 5
    q = (F.when(n == 0, F.concat(F.lit("Show top "), F.col("p_size").cast("string"), F.lit(" "), "p_type"))
         .when(n == 1, F.concat(F.lit("why did "), "p_brand", F.lit(" drop")))
         .when(n == 2, F.concat(F.lit("help with "), "p_name"))
         .when(n == 3, F.concat(F.lit("Compare trend of "), "p_type"))
         .otherwise(F.concat("p_name", F.lit(" please"))))
    return t.part.select("p_partkey", q.alias("question")).withColumn("label", text.intent(F.col("question")))


@query("txt_intent_conversations", rf"""SELECT conv_id, turn,
  CASE WHEN length(trim(text)) < 30 AND regexp_matches(lower(text), '{_pattern(text.GENERAL_WORDS)}') THEN 'general'
  WHEN regexp_matches(lower(text), '{_pattern(text.ANALYTICAL_WORDS)}') THEN 'analytical'
  WHEN regexp_matches(lower(text), '{_pattern(text.DATA_WORDS)}') THEN 'data_query' ELSE 'ambiguous' END AS label
FROM conversations WHERE role = 'user'""")
def txt_intent_conversations(t):
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", text.intent(F.col("text")).alias("label"))
