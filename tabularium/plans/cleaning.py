"""Registered cleaning, outlier and derived-column queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions.dates import weekday_number
from tabularium.functions.numbers import display2, r4
from tabularium.functions.parsing import DATE_FORMATS_SQL, NUMBER
from tabularium.operators import clean, features, ordering, stats
from tabularium.plans.inputs import DIRTY_SQL, SALES_SQL, dirty_lineitem, sales_wide
from tabularium.plans.registry import query

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = ", ".join(KEYS)


def rows_of(t, *columns):
    return dirty_lineitem(t).select(*KEYS, *columns)


# ---- null filling --------------------------------------------------------------------------------------

@query("fill_zero", f"WITH {DIRTY_SQL} SELECT {K}, coalesce(quantity, 0) AS quantity FROM dirty")
def fill_zero(t):
    return clean.fill(rows_of(t, "quantity"), "quantity", "zero")


@query("fill_mean", f"""WITH {DIRTY_SQL}
SELECT {K}, round(coalesce(quantity, avg(quantity) OVER ()), 4) AS quantity FROM dirty""")
def fill_mean(t):
    return clean.fill(rows_of(t, "quantity"), "quantity", "mean").withColumn("quantity", F.round("quantity", 4))


@query("fill_median", f"""WITH {DIRTY_SQL}
SELECT {K}, coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM dirty)) AS quantity FROM dirty""")
def fill_median(t):
    return clean.fill(rows_of(t, "quantity"), "quantity", "median")


@query("fill_mode", f"""WITH {DIRTY_SQL}
SELECT {K}, coalesce(flag, (SELECT flag FROM dirty WHERE flag IS NOT NULL GROUP BY flag
  ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM dirty""")
def fill_mode(t):
    return clean.fill(rows_of(t, "flag"), "flag", "mode")


@query("fill_drop_rows", f"WITH {DIRTY_SQL} SELECT {K}, quantity FROM dirty WHERE quantity IS NOT NULL")
def fill_drop_rows(t):
    return clean.fill(rows_of(t, "quantity"), "quantity", "drop")


@query("fill_empty", f"""WITH {DIRTY_SQL}
SELECT {K}, coalesce(flag, '') AS flag, coalesce(note, 'Unknown') AS note FROM dirty""")
def fill_empty(t):
    return clean.fill(clean.fill(rows_of(t, "flag", "note"), "flag", "empty"), "note", "empty", "Unknown")


FILL_KEYS = [*KEYS, "price", "qty_text"]  # a total order; KEYS alone repeat on small scales
FILL_ORDER = ", ".join(FILL_KEYS)


@query("fill_ffill", f"""WITH {DIRTY_SQL}
SELECT {K}, last_value(quantity IGNORE NULLS) OVER (ORDER BY {FILL_ORDER}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS quantity FROM dirty""")
def fill_ffill(t):
    return ordering.fill_along(rows_of(t, "quantity", "price", "qty_text"), "quantity", FILL_KEYS).drop("price", "qty_text")


@query("fill_bfill", f"""WITH {DIRTY_SQL}
SELECT {K}, first_value(quantity IGNORE NULLS) OVER (ORDER BY {FILL_ORDER}
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS quantity FROM dirty""")
def fill_bfill(t):
    rows = rows_of(t, "quantity", "price", "qty_text")
    return ordering.fill_along(rows, "quantity", FILL_KEYS, forward=False).drop("price", "qty_text")


@query("auto_null_fill", f"""WITH {DIRTY_SQL}
SELECT {K}, coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM dirty)) AS quantity, price, discount,
  coalesce(flag, (SELECT flag FROM dirty WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1))
  AS flag, qty_text, date_text, currency FROM dirty""")
def auto_null_fill(t):
    return clean.auto_fill(dirty_lineitem(t))[0]


@query("auto_null_decisions", f"""WITH {DIRTY_SQL}, s AS (
  SELECT count(*) AS n, count(*) - count(quantity) AS q, count(*) - count(flag) AS f, count(*) - count(note) AS o
  FROM dirty)
SELECT 'quantity' AS column_name, CASE WHEN q / n > 0.7 THEN 'dropped_column (>70% missing)' ELSE 'Fill with median' END
  AS decision FROM s WHERE q > 0
UNION ALL SELECT 'flag', CASE WHEN f / n > 0.7 THEN 'dropped_column (>70% missing)' ELSE 'Fill with mode' END
  FROM s WHERE f > 0
UNION ALL SELECT 'note', CASE WHEN o / n > 0.7 THEN 'dropped_column (>70% missing)' ELSE 'Fill with mode' END
  FROM s WHERE o > 0""")
def auto_null_decisions(t):
    return clean.null_decisions(dirty_lineitem(t))


@query("null_drop_columns", f"WITH {DIRTY_SQL} SELECT * EXCLUDE (note) FROM dirty")
def null_drop_columns(t):
    return clean.drop_sparse_columns(dirty_lineitem(t))


@query("prj_null_columns", f"WITH {DIRTY_SQL} SELECT quantity, flag, note FROM dirty")
def prj_null_columns(t):
    dirty = dirty_lineitem(t)
    return dirty.select(*clean.columns_with_nulls(dirty))


# ---- duplicates ----------------------------------------------------------------------------------------

@query("dedup_keep", f"WITH {DIRTY_SQL} SELECT DISTINCT * FROM dirty")
def dedup_keep(t):
    return clean.dedup(dirty_lineitem(t), "first")


@query("dedup_drop_all", f"""WITH {DIRTY_SQL}
SELECT * FROM dirty GROUP BY ALL HAVING count(*) = 1""")
def dedup_drop_all(t):
    return clean.dedup(dirty_lineitem(t), "none")


@query("dedup_subset_last", """
SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 4) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def dedup_subset_last(t):
    events = t.events.select("user_id", "event_type", "event_id", "ts", "value")
    kept = clean.dedup(events, "last", ["user_id", "event_type"], ["ts", "event_id"])
    return kept.select("user_id", "event_type", "event_id",
                       F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r4(F.col("value")).alias("value"))


# ---- casts ---------------------------------------------------------------------------------------------

@query("cast_integer", f"""WITH {DIRTY_SQL}
SELECT {K}, CASE WHEN regexp_matches(trim(qty_text), '{NUMBER}') THEN CAST(trunc(CAST(qty_text AS DOUBLE)) AS BIGINT)
  ELSE 0 END AS qty_text FROM dirty""")
def cast_integer(t):
    return clean.cast_columns(rows_of(t, "qty_text"), {"qty_text": "Integer"})


@query("cast_float", f"""WITH {DIRTY_SQL}
SELECT {K}, CASE WHEN regexp_matches(trim(qty_text), '{NUMBER}') THEN CAST(qty_text AS DOUBLE) ELSE 0.0 END AS qty_text
FROM dirty""")
def cast_float(t):
    return clean.cast_columns(rows_of(t, "qty_text"), {"qty_text": "Float"})


@query("cast_string", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey
FROM orders""")
def cast_string(t):
    return clean.cast_columns(t.orders.select("o_orderkey", "o_custkey"), {"o_orderkey": "String", "o_custkey": "String"})


BOOL_TEXT_SQL = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' Yes ' WHEN 'O' THEN 'no' ELSE
  CASE WHEN o_custkey % 2 = 0 THEN '1' ELSE 'maybe' END END AS answer FROM orders"""


@query("cast_boolean", f"""SELECT o_orderkey, CASE WHEN lower(trim(answer)) IN ('true', '1', 'yes', 'y') THEN true
  WHEN lower(trim(answer)) IN ('false', '0', 'no', 'n') THEN false END AS answer FROM ({BOOL_TEXT_SQL})""")
def cast_boolean(t):
    status = F.col("o_orderstatus")
    answer = (F.when(status == "F", " Yes ").when(status == "O", "no")
              .when(F.col("o_custkey") % 2 == 0, "1").otherwise("maybe"))
    return clean.cast_columns(t.orders.select("o_orderkey", answer.alias("answer")), {"answer": "Boolean"})


@query("cast_date", f"""WITH {DIRTY_SQL} SELECT {K},
  strftime(try_strptime(CASE WHEN l_suppkey % 2 = 0 AND date_text <> 'unknown'
    THEN substr(date_text, 6, 2) || '/' || substr(date_text, 9, 2) || '/' || substr(date_text, 1, 4)
    ELSE date_text END, {DATE_FORMATS_SQL}), '%Y-%m-%d') AS day FROM dirty""")
def cast_date(t):
    text = F.col("date_text")
    slashed = F.concat(F.substring(text, 6, 2), F.lit("/"), F.substring(text, 9, 2), F.lit("/"), F.substring(text, 1, 4))
    mixed = F.when((F.col("l_suppkey") % 2 == 0) & (text != "unknown"), slashed).otherwise(text)
    parsed = clean.cast_column(mixed, "Date")
    return dirty_lineitem(t).select(*KEYS, F.date_format(parsed, "yyyy-MM-dd").alias("day"))


@query("auto_cast", f"""WITH {DIRTY_SQL} SELECT {K}, flag,
  CASE WHEN qty_text <> 'n/a' THEN CAST(qty_text AS DOUBLE) END AS qty_text,
  strftime(try_strptime(date_text, {DATE_FORMATS_SQL}), '%Y-%m-%d') AS date_text FROM dirty""")
def auto_cast(t):
    out, _ = clean.auto_cast(rows_of(t, "flag", "qty_text", "date_text"))
    return out.withColumn("date_text", F.date_format("date_text", "yyyy-MM-dd"))


# ---- outliers ------------------------------------------------------------------------------------------

FENCE_SQL = """fence AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM dirty))"""


@query("outlier_remove", f"""WITH {DIRTY_SQL}, {FENCE_SQL}
SELECT {K}, price FROM dirty, fence WHERE price BETWEEN lo AND hi""")
def outlier_remove(t):
    return clean.outliers(rows_of(t, "price"), "price", "remove")


@query("outlier_iqr_cap", f"""WITH {DIRTY_SQL}, {FENCE_SQL}
SELECT {K}, round(CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END, 4) AS price FROM dirty, fence""")
def outlier_iqr_cap(t):
    return clean.outliers(rows_of(t, "price"), "price", "iqr").withColumn("price", r4(F.col("price")))


@query("outlier_z_cap", f"""WITH {DIRTY_SQL}, s AS (SELECT {K}, price, avg(price) OVER () AS m, stddev_samp(price) OVER () AS d FROM dirty)
SELECT {K}, round(CASE WHEN price < m - 3 * d THEN m - 3 * d WHEN price > m + 3 * d THEN m + 3 * d ELSE price END, 4) AS price FROM s""")
def outlier_z_cap(t):
    return clean.outliers(rows_of(t, "price"), "price", "zscore").withColumn("price", r4(F.col("price")))


@query("outlier_steps", f"""WITH {DIRTY_SQL}, {FENCE_SQL},
kept AS (SELECT dirty.* FROM dirty, fence WHERE price BETWEEN lo AND hi),
second AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3 FROM kept))
SELECT {K}, price, round(CASE WHEN quantity < lo THEN lo WHEN quantity > hi THEN hi ELSE quantity END, 4) AS quantity
FROM kept, second""")
def outlier_steps(t):
    """Manual chain: the second column's fences are taken after the first column's removal."""
    out = clean.outliers_in_turn(rows_of(t, "price", "quantity"), {"price": "remove", "quantity": "iqr"})
    return out.withColumn("quantity", r4(F.col("quantity")))


@query("auto_outlier_cap", f"""WITH {DIRTY_SQL}, {FENCE_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity,
  round(CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END, 4) AS price, discount FROM dirty, fence""")
def auto_outlier_cap(t):
    out, _ = clean.auto_cap(rows_of(t, "quantity", "price", "discount"))
    return out.withColumn("price", r4(F.col("price")))


@query("auto_outlier_decisions", f"""WITH {DIRTY_SQL}, long AS (
  UNPIVOT (SELECT quantity, price, discount FROM dirty) ON quantity, price, discount INTO NAME column_name VALUE v),
f AS (SELECT column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY 1)
SELECT f.column_name, count(*) AS outliers, 'IQR capping' AS decision FROM long JOIN f USING (column_name)
WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def auto_outlier_decisions(t):
    cells = stats.outlier_cells(dirty_lineitem(t), ["quantity", "price", "discount"])
    return cells.filter("outliers > 0").select("column_name", "outliers", F.lit("IQR capping").alias("decision"))


# ---- text ----------------------------------------------------------------------------------------------

@query("txt_clean_ops", """SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed,
  array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS titled,
  regexp_replace(p_brand || ' (' || p_type || ')', '[^A-Za-z0-9 ]', '', 'g') AS plain,
  floor(round(p_retailprice * 1.075, 4) * 100.0 + 0.5) / 100.0 AS price2 FROM part""")
def txt_clean_ops(t):
    brand = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return t.part.select(
        "p_partkey", clean.tidy_text(F.concat(F.lit("  "), "p_name", F.lit(" ")), "trim").alias("trimmed"),
        clean.tidy_text(F.col("p_name"), "title").alias("titled"),
        clean.tidy_text(brand, "remove_special").alias("plain"),
        display2(F.col("p_retailprice") * 1.075).alias("price2"))


@query("txt_standard_date", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders""")
def txt_standard_date(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))


# ---- derived columns -----------------------------------------------------------------------------------

@query("feat_normalize", f"""WITH {DIRTY_SQL}, x AS (SELECT max(coalesce(price, 0)) AS m FROM dirty)
SELECT {K}, round(CASE WHEN m = 0 THEN 0.0 ELSE coalesce(price, 0) / m END, 6) AS price_norm FROM dirty, x""")
def feat_normalize(t):
    out = features.derive(rows_of(t, "price"), "price_norm", "normalize", ["price"])
    return out.select(*KEYS, F.round("price_norm", 6).alias("price_norm"))


@query("feat_flag", f"""WITH {DIRTY_SQL}
SELECT {K}, CASE WHEN flag IS NOT NULL AND trim(flag) <> '' THEN 1 ELSE 0 END AS has_flag FROM dirty""")
def feat_flag(t):
    return features.derive(rows_of(t, "flag"), "has_flag", "boolean_flag", ["flag"]).drop("flag")


@query("feat_product", f"""WITH {DIRTY_SQL} SELECT {K}, round(coalesce(quantity, 0) * price * discount, 4) + 0.0 AS v
FROM dirty""")
def feat_product(t):
    out = features.derive(rows_of(t, "quantity", "price", "discount"), "v", "product", ["quantity", "price", "discount"])
    return out.select(*KEYS, r4(F.col("v")).alias("v"))


@query("feat_sum", f"""WITH {DIRTY_SQL} SELECT {K}, round(coalesce(quantity, 0) + price +
  CASE WHEN qty_text = 'n/a' THEN 0 ELSE CAST(qty_text AS DOUBLE) END, 4) AS v FROM dirty""")
def feat_sum(t):
    out = features.derive(rows_of(t, "quantity", "price", "qty_text"), "v", "sum", ["quantity", "price", "qty_text"])
    return out.select(*KEYS, r4(F.col("v")).alias("v"))


@query("feat_difference", f"WITH {DIRTY_SQL} SELECT {K}, round(price - coalesce(quantity, 0), 4) AS v FROM dirty")
def feat_difference(t):
    out = features.derive(rows_of(t, "quantity", "price"), "v", "difference", ["price", "quantity"])
    return out.select(*KEYS, r4(F.col("v")).alias("v"))


@query("feat_ratio", f"""WITH {DIRTY_SQL}
SELECT {K}, CASE WHEN coalesce(quantity, 0) = 0 THEN NULL ELSE price / quantity END AS v FROM dirty""")
def feat_ratio(t):
    out = features.derive(rows_of(t, "quantity", "price"), "v", "ratio", ["price", "quantity"])
    return out.select(*KEYS, "v")


@query("feat_log", f"""WITH {DIRTY_SQL}
SELECT {K}, round(ln(1 + greatest(coalesce(quantity, 0), 0)), 6) AS v FROM dirty""")
def feat_log(t):
    out = features.derive(rows_of(t, "quantity"), "v", "log", ["quantity"])
    return out.select(*KEYS, F.round("v", 6).alias("v"))


@query("feat_zscore", f"""WITH {DIRTY_SQL}, f AS (SELECT {K}, coalesce(quantity, 0) AS x FROM dirty),
s AS (SELECT *, avg(x) OVER () AS m, stddev_samp(x) OVER () AS d FROM f)
SELECT {K}, round(CASE WHEN d > 0 THEN (x - m) / d ELSE 0 END, 6) AS v FROM s""")
def feat_zscore(t):
    out = features.derive(rows_of(t, "quantity"), "v", "zscore", ["quantity"])
    return out.select(*KEYS, F.round("v", 6).alias("v"))


@query("feat_binning", f"""WITH {DIRTY_SQL}, s AS (
  SELECT min(coalesce(quantity, 0)) AS lo, max(coalesce(quantity, 0)) AS hi FROM dirty)
SELECT {K}, CAST(least(4, greatest(0, ceil((coalesce(quantity, 0) - lo) / ((hi - lo) / 5.0)) - 1)) AS INTEGER) AS v
FROM dirty, s""")
def feat_binning(t):
    return features.derive(rows_of(t, "quantity"), "v", "binning", ["quantity"], 5).drop("quantity")


@query("feat_derived_sales", f"""WITH {DIRTY_SQL}
SELECT {K}, round(greatest(coalesce(price, 0), 0) * greatest(coalesce(quantity, 0), 0), 4) AS derived_sales FROM dirty""")
def feat_derived_sales(t):
    made = features.derived_sales(F.col("price"), F.col("quantity"))
    return dirty_lineitem(t).select(*KEYS, r4(made).alias("derived_sales"))


@query("feat_date_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y,
  CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow FROM orders""")
def feat_date_parts(t):
    at = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.year(at).alias("y"), F.month(at).alias("m"),
                           F.dayofmonth(at).alias("d"), weekday_number(at).alias("dow"))


@query("feat_label_encode", f"""WITH {DIRTY_SQL}, x AS (SELECT *, coalesce(flag, 'nan') AS f, coalesce(note, 'nan') AS o
FROM dirty) SELECT {K}, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS flag_code,
  CAST(dense_rank() OVER (ORDER BY o) - 1 AS INTEGER) AS note_code FROM x""")
def feat_label_encode(t):
    return features.label_encode(rows_of(t, "flag", "note"), ["flag", "note"]).drop("flag", "note")


@query("feat_standard_scale", """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / d, 6) + 0.0 AS o_totalprice_scaled FROM orders, s""")
def feat_standard_scale(t):
    out = features.standard_scale(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return out.select("o_orderkey", (F.round("o_totalprice_scaled", 6) + F.lit(0.0)).alias("o_totalprice_scaled"))


REL_COLUMNS = ["l_quantity", "unit_price", "gross", "l_discount", "net", "shifted"]
REL_SQL = """SELECT l_quantity, p_retailprice AS unit_price, l_quantity * p_retailprice AS gross, l_discount,
  l_quantity * p_retailprice * (1 - l_discount) AS net, l_quantity + p_retailprice AS shifted
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _rel_sql() -> str:
    parts = []
    for i, a in enumerate(REL_COLUMNS):
        for b in REL_COLUMNS[i + 1:]:
            for target in REL_COLUMNS:
                if target not in (a, b):
                    for sign, kind in (("*", "multiplication"), ("+", "addition")):
                        parts.append(f"SELECT '{target}' AS target, '{a} {sign} {b}' AS formula, '{kind}' AS type, "
                                     f"corr({a} {sign} {b}, {target}) AS r FROM x")
    return f"""WITH x AS ({REL_SQL}) SELECT target, formula, type, round(r, 4) AS correlation FROM (
{" UNION ALL ".join(parts)}) WHERE abs(r) > 0.98"""


@query("rel_detect", _rel_sql())
def rel_detect(t):
    q, p, d = F.col("l_quantity"), F.col("p_retailprice"), F.col("l_discount")
    wide = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        q, p.alias("unit_price"), (q * p).alias("gross"), d, (q * p * (1 - d)).alias("net"), (q + p).alias("shifted"))
    return features.relationships(wide)


@query("feat_suggested", f"""WITH {SALES_SQL} SELECT order_key, line_no, part_key, supp_key,
  sales / nullif(quantity, 0) AS sales_per_quantity, round(profit / nullif(sales, 0), 4) + 0.0 AS profit_margin,
  round(ln(1 + greatest(sales, 0)), 6) AS sales_log, round(ln(1 + greatest(quantity, 0)), 6) AS quantity_log,
  round(ln(1 + greatest(profit, 0)), 6) AS profit_log FROM sales_wide""")
def feat_suggested(t):
    keys = ["order_key", "line_no", "part_key", "supp_key"]
    wide = sales_wide(t, [*keys, "sales", "quantity", "profit"])
    out = features.derive_all(wide, features.suggest(wide.drop(*keys)))
    return out.select(*keys, "sales_per_quantity", r4(F.col("profit_margin")).alias("profit_margin"),
                      *[F.round(c, 6).alias(c) for c in ("sales_log", "quantity_log", "profit_log")])


@query("fe_drop_highcard", """WITH s AS (SELECT count(*) AS n, count(DISTINCT c_name) AS name_u,
  count(DISTINCT c_mktsegment) AS seg_u FROM customer)
SELECT 'c_name' AS column_name, name_u AS nunique, name_u <= n * 0.5 AS kept FROM s
UNION ALL SELECT 'c_mktsegment', seg_u, seg_u <= n * 0.5 FROM s""")
def fe_drop_highcard(t):
    return features.codable_columns(t.customer)
