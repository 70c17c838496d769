"""Registered source, sink, wizard and ad-hoc SQL queries.

Files are written to the shared scratch folder from the given tables and read back from there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions.numbers import r4
from tabularium.operators import clean, filters, stats
from tabularium.plans import adhoc, wizard
from tabularium.plans.inputs import DIRTY_SQL, SALES_SQL, dirty_lineitem, sales_by_part, sales_wide
from tabularium.plans.registry import query
from tabularium.session import scratch_path
from tabularium.sources import files, pages, readers, sinks
from tabularium.tables import TABLE_NAMES

LINE_SCHEMA = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_returnflag string, day date"


def _lines(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", F.to_date("l_shipdate").alias("day"))


@query("src_csv_roundtrip", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, CAST(l_shipdate AS DATE) AS day FROM lineitem""")
def src_csv_roundtrip(t):
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(_lines(t), path)
    return readers.read(t.spark, "csv", path=path, schema=LINE_SCHEMA)


@query("src_csv_inferred", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def src_csv_inferred(t):
    path = scratch_path(t.spark, "csv-infer")
    sinks.write_csv(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    return files.read_csv(t.spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("src_csv_strings", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def src_csv_strings(t):
    path = scratch_path(t.spark, "csv-text")
    sinks.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_custkey", F.to_date("o_orderdate").alias("day")), path)
    return files.read_csv_text(t.spark, path)


@query("src_csv_latin1", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'Société ' || c_name AS company FROM customer")
def src_csv_latin1(t):
    path = scratch_path(t.spark, "csv-latin")
    sinks.write_csv(t.customer.select("c_custkey", F.concat(F.lit("Société "), "c_name").alias("company")), path, "ISO-8859-1")
    return files.read_csv_text(t.spark, path)


def _raw_folder(t):
    """Customers as CSV lines behind three junk lines, a padded header with an unnamed column, and footer-like rows."""
    path = scratch_path(t.spark, "raw")
    top = t.spark.createDataFrame([("Customer export",), ("",), ("2024,,,,",), (" custkey ,name,segment , balance,",)], "value string").coalesce(1)
    c = t.customer
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit("  "), "c_name", F.lit(" ")),
                       F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_mktsegment")), F.col("c_acctbal").cast("string"), F.lit(""))
    line = F.when(F.col("c_nationkey") == 7, F.concat(F.lit("total,,,,"))).otherwise(line)
    top.union(c.select(line.alias("value"))).write.text(path)
    return path


RAW_SQL = """SELECT CASE WHEN c_nationkey = 7 THEN 'total' ELSE CAST(c_custkey AS VARCHAR) END AS custkey,
  CASE WHEN c_nationkey <> 7 THEN c_name END AS name, CASE WHEN c_nationkey NOT IN (3, 7) THEN c_mktsegment END AS segment,
  CASE WHEN c_nationkey <> 7 THEN CAST(c_acctbal AS VARCHAR) END AS balance FROM customer"""


@query("src_header_detect", RAW_SQL)
def src_header_detect(t):
    return files.sanitise(files.read_csv_with_preamble(t.spark, _raw_folder(t)))


@query("src_sanitize", f"""WITH {DIRTY_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(flag) AS flag,
  CASE WHEN l_orderkey % 10 = 0 THEN note END AS note FROM dirty""")
def src_sanitize(t):
    raw = dirty_lineitem(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                   F.col("flag").alias(" flag "), F.coalesce("note", F.lit("  ")).alias("note"),
                                   F.lit("x").alias("Unnamed: 6"))
    return files.sanitise(raw)


@query("src_footer_drop", f"""WITH {DIRTY_SQL}, s AS (SELECT CASE WHEN l_orderkey % 9 <> 0 THEN quantity END AS a,
  CASE WHEN l_orderkey % 9 <> 0 THEN flag END AS b, note AS c, CASE WHEN l_orderkey % 9 <> 0 THEN qty_text END AS d,
  l_orderkey AS e FROM dirty) SELECT e, count(*) AS n FROM (SELECT * FROM (SELECT a, b, c, d, CASE WHEN e % 9 <> 0 OR e % 2 = 0 THEN e END AS e FROM s)
  WHERE ((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT + (d IS NULL)::INT + (e IS NULL)::INT) / 5 <= 0.8) GROUP BY 1""")
def src_footer_drop(t):
    ninth = F.col("l_orderkey") % 9 != 0
    rows = dirty_lineitem(t).select(F.when(ninth, F.col("quantity")).alias("a"), F.when(ninth, F.col("flag")).alias("b"),
                                    F.col("note").alias("c"), F.when(ninth, F.col("qty_text")).alias("d"),
                                    F.when(ninth | (F.col("l_orderkey") % 2 == 0), F.col("l_orderkey")).alias("e"))
    return filters.sparse_rows_dropped(rows).groupBy("e").agg(F.count(F.lit(1)).alias("n"))


def _write_pages(t, rows, key, name, label):
    """Write JSON pages of at most 100 records: ``{name: [record…]}`` per line. Pages are cut by key range."""
    path = scratch_path(t.spark, label)
    page = F.floor(F.col(key) / F.lit(100))
    rows.groupBy(page.alias("page")).agg(F.collect_list("record").alias(name)).write.json(path)
    return path


@query("src_json_nested", "SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events")
def src_json_nested(t):
    events = t.events.select("event_id", F.struct("event_id", "user_id", "event_type", "value").alias("record"))
    path = _write_pages(t, events, "event_id", "data", "json")
    return files.read_json_rows(t.spark, path).select("event_id", "user_id", "event_type", r4(F.col("value")).alias("value"))


@query("src_pages_records", """SELECT 'rec' || c_custkey AS _airtable_id, c_name AS "Name", c_mktsegment AS "Segment", c_acctbal AS "Balance" FROM customer""")
def src_pages_records(t):
    rows = t.customer.select("c_custkey", F.struct(
        F.concat(F.lit("rec"), F.col("c_custkey").cast("string")).alias("id"),
        F.struct(F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Segment"), F.col("c_acctbal").alias("Balance")).alias("fields")).alias("record"))
    return pages.records(t.spark, _write_pages(t, rows, "c_custkey", "records", "records"))


@query("src_pages_properties", """SELECT CAST(s_suppkey AS VARCHAR) AS _hubspot_id, s_name AS company, CAST(s_nationkey AS BIGINT) AS nation FROM supplier""")
def src_pages_properties(t):
    rows = t.supplier.select("s_suppkey", F.struct(
        F.col("s_suppkey").cast("string").alias("id"),
        F.struct(F.col("s_name").alias("company"), F.col("s_nationkey").alias("nation")).alias("properties")).alias("record"))
    return pages.properties(t.spark, _write_pages(t, rows, "s_suppkey", "results", "results"))


@query("src_pages_typed_props", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS "Name", CAST(CAST(p_size AS DOUBLE) AS VARCHAR) AS "Size",
  p_brand AS "Brand", p_type || ', ' || p_brand AS "Tags", CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS "Large",
  '2024-01-0' || (1 + p_size % 9) AS "Since" FROM part""")
def src_pages_typed_props(t):
    kind = lambda name, value: F.to_json(F.struct(F.lit(name).alias("type"), value.alias(name)))
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("plain_text")))
    prop = lambda key, text: F.concat(F.lit(f'"{key}":'), text)
    body = F.concat_ws(
        ",", prop("Name", kind("title", words)), prop("Size", kind("number", F.col("p_size"))),
        prop("Brand", kind("select", F.struct(F.col("p_brand").alias("name")))),
        prop("Tags", kind("multi_select", F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.col("p_brand").alias("name"))))),
        prop("Large", kind("checkbox", F.col("p_size") > 25)),
        prop("Since", kind("date", F.struct(F.concat(F.lit("2024-01-0"), (F.col("p_size") % 9 + 1).cast("string")).alias("start")))))
    record = F.concat(F.lit('{"id":"'), F.col("p_partkey").cast("string"), F.lit('","properties":{'), body, F.lit("}}"))
    path = scratch_path(t.spark, "typed")
    (t.part.groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.array_join(F.collect_list(record), ",").alias("rows"))
     .select(F.concat(F.lit('{"results":['), "rows", F.lit("]}")).alias("value")).write.text(path))
    return pages.typed_properties(t.spark, path)


@query("src_report_rows", """SELECT strftime(ts, '%Y%m%d') AS day, event_type, CAST(count(*) AS DOUBLE) AS hits, round(sum(value), 4) AS total
FROM events GROUP BY 1, 2""")
def src_report_rows(t):
    cells = lambda *cs: F.array(*[F.struct(c.cast("string").alias("value")) for c in cs])
    per_day = t.events.groupBy(F.date_format("ts", "yyyyMMdd").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("value").alias("total"))
    report = per_day.groupBy("day").agg(F.collect_list(F.struct(
        cells(F.col("day"), F.col("event_type")).alias("dimension_values"), cells(F.col("hits"), F.col("total")).alias("metric_values"))).alias("rows"))
    return pages.report_rows(report, ["day", "event_type"], ["hits", "total"]).withColumn("total", r4(F.col("total")))


@query("ga_sessions_by_date", "SELECT strftime(ts, '%Y%m%d') AS date, count(*) AS sessions, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def ga_sessions_by_date(t):
    return t.events.groupBy(F.date_format("ts", "yyyyMMdd").alias("date")).agg(
        F.count(F.lit(1)).alias("sessions"), F.countDistinct("user_id").alias("users"))


@query("ga_top_pages", """SELECT json_extract_string(props, '$.k') AS page, count(*) AS views FROM events WHERE event_type = 'view'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def ga_top_pages(t):
    views = t.events.filter("event_type = 'view'").groupBy(F.get_json_object("props", "$.k").alias("page")).agg(F.count(F.lit(1)).alias("views"))
    return views.orderBy(F.desc("views"), "page").limit(20)


@query("ga_events_by_type", "SELECT event_type, count(*) AS events, count(*) FILTER (value > 20) AS conversions FROM events GROUP BY 1")
def ga_events_by_type(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") > 20).alias("conversions"))


@query("ga_traffic_by_source", "SELECT source, lang AS medium, count(*) AS sessions, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def ga_traffic_by_source(t):
    return t.documents.groupBy("source", F.col("lang").alias("medium")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("n_chars").alias("chars"))


@query("src_preview", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def src_preview(t):
    return files.preview(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])


@query("src_capped_rows", """SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total_rows, (SELECT least(count(*), 10000) FROM orders) AS row_count_stored,
  (SELECT count(*) > 10000 FROM orders) AS truncated FROM orders ORDER BY o_orderkey LIMIT 10000""")
def src_capped_rows(t):
    """The preview store's first 10,000 rows; the cap is the feature."""
    return files.capped(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 10_000)


@query("src_list_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLE_NAMES))
def src_list_tables(t):
    """Tables of the folder with their sizes; counts come from the file footers."""
    out = None
    for name in files.list_tables(t.spark, t.folder):
        one = t.spark.read.parquet(t.path(name)).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("export_normalise", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 1 THEN l_quantity END AS l_quantity,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS l_shipdate FROM lineitem""")
def export_normalise(t):
    odd = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return files.export_values(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", odd.alias("l_quantity"), "l_shipdate"))


@query("src_line_count", "SELECT count(*) + 1 AS lines FROM orders")
def src_line_count(t):
    path = scratch_path(t.spark, "lines")
    top = t.spark.createDataFrame([("o_orderkey",)], "value string")
    top.union(t.orders.select(F.col("o_orderkey").cast("string"))).write.text(path)
    return files.line_count(t.spark, path)


@query("src_magic_bytes", """SELECT folder, 'csv' AS kind, folder = 'ok' AS all_safe FROM (SELECT unnest(['ok', 'bad']) AS folder) WHERE EXISTS (FROM customer)""")
def src_magic_bytes(t):
    """First-byte check of files written from the customer table."""
    path = scratch_path(t.spark, "bytes")
    t.customer.select("c_custkey", "c_name").write.option("header", True).csv(f"{path}/ok")
    t.customer.select(F.concat(F.lit("a\u0000"), "c_name")).write.csv(f"{path}/bad")
    found = files.content_kinds(t.spark, path).filter(F.rlike("path", F.lit("/part-")))
    return found.groupBy(F.regexp_extract("path", "/(ok|bad)/", 1).alias("folder"), "kind").agg(
        (F.count_if(F.col("looks_safe")) == F.count(F.lit(1))).alias("all_safe"))


# ---- sinks ---------------------------------------------------------------------------------------------

@query("snk_json_artifact", f"""WITH {SALES_SQL} SELECT product, round(sum(sales), 4) AS sales, round(sum(profit), 4) AS profit FROM sales_wide GROUP BY 1""")
def snk_json_artifact(t):
    path = scratch_path(t.spark, "artifact")
    totals = sales_by_part(t).groupBy("product").agg(r4(F.sum("sales")).alias("sales"), r4(F.sum("profit")).alias("profit"))
    sinks.write_json(totals, path)
    return t.spark.read.schema(totals.schema).json(path)


@query("snk_snapshot_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLE_NAMES))
def snk_snapshot_counts(t):
    path = scratch_path(t.spark, "snapshot")
    sinks.snapshot({n: getattr(t, n) for n in TABLE_NAMES}, path)
    out = None
    for name in TABLE_NAMES:
        one = t.spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("upsert_latest", """SELECT o_custkey, CASE WHEN p = 'new' THEN 'granted' ELSE o_orderpriority END AS permission, CAST(v AS BIGINT) AS version FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC) AS r FROM (
    SELECT o_custkey, o_orderpriority, o_orderkey AS v, 'old' AS p FROM orders
    UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey + 1000000000, 'new' FROM orders WHERE o_orderstatus = 'P')) WHERE r = 1""")
def upsert_latest(t):
    old = t.orders.select("o_custkey", F.col("o_orderpriority").alias("permission"), F.col("o_orderkey").alias("version"))
    new = t.orders.filter("o_orderstatus = 'P'").select("o_custkey", F.lit("granted").alias("permission"), (F.col("o_orderkey") + 1000000000).alias("version"))
    return sinks.upsert(old, new, ["o_custkey"], "version")


@query("soft_revoke", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN false ELSE true END AS can_view FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def soft_revoke(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("can_view"))
    revoked = sinks.update_where(rows, F.col("o_orderstatus") == "F", {"can_view": F.lit(False)})
    return sinks.delete_keys(revoked, t.customer.filter("c_mktsegment = 'BUILDING'"), ["c_custkey"]).select("o_orderkey", "can_view")


# ---- wizard --------------------------------------------------------------------------------------------

def _run_wizard(t):
    steps = wizard.Wizard(dirty_lineitem(t))
    for step in ("null_values", "duplicates", "data_types", "outliers"):
        steps.apply(step)
    steps.apply("feature_engineering", {"features": [{"col": "line_value", "operation": "product", "inputs": ["quantity", "price"]}]})
    return steps


FILLED_SQL = f"""{DIRTY_SQL}, filled AS (SELECT * EXCLUDE (note, quantity, flag),
  coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM dirty)) AS quantity,
  coalesce(flag, (SELECT flag FROM dirty WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM dirty),
single AS (SELECT DISTINCT * FROM filled),
n AS (SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS d0,
  (SELECT count(*) FROM dirty) AS r0, (SELECT count(*) FROM single) AS r1,
  (SELECT count(*) FILTER (quantity IS NULL) + count(*) FILTER (flag IS NULL) + count(*) FILTER (note IS NULL) FROM dirty) AS n0,
  (SELECT count(*) FILTER (qty_text = 'n/a') + count(*) FILTER (date_text = 'unknown') FROM single) AS n1)"""


def _lineage_row(position, step, mode, decisions, **counts):
    values = [f"CAST({v} AS {'INTEGER' if name == 'cols' else 'BIGINT'}) AS {name}_{when}"
              for name, pair in counts.items() for when, v in zip(("before", "after"), pair)]
    return (f"SELECT CAST({position} AS INTEGER) AS position, '{step}' AS step, '{mode}' AS mode, '{decisions}' AS decisions, "
            + ", ".join(values) + " FROM n")


@query("wizard_lineage", f"WITH {FILLED_SQL} " + " UNION ALL ".join([
    _lineage_row(1, "null_values", "auto", "flag: Fill with mode, note: dropped_column (>70% missing), quantity: Fill with median",
                 rows=("r0", "r0"), cols=(12, 11), nulls=("n0", "0"), copies=("d0", "r0 - r1")),
    _lineage_row(2, "duplicates", "auto", "strategy: Keep first", rows=("r0", "r1"), cols=(11, 11), nulls=("0", "0"), copies=("r0 - r1", "0")),
    _lineage_row(3, "data_types", "auto", "date_text: Date, qty_text: Float", rows=("r1", "r1"), cols=(11, 11), nulls=("0", "n1"), copies=("0", "0")),
    _lineage_row(4, "outliers", "auto", "price: IQR capping", rows=("r1", "r1"), cols=(11, 11), nulls=("n1", "n1"), copies=("0", "0")),
    _lineage_row(5, "feature_engineering", "manual", "line_value: product", rows=("r1", "r1"), cols=(11, 12), nulls=("n1", "n1"), copies=("0", "0"))]))
def wizard_lineage(t):
    return _run_wizard(t).lineage(copies=True)


@query("cleaning_report", f"""WITH {FILLED_SQL}, q AS (SELECT price, quantity, discount, qty_text FROM single),
f AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM single)
SELECT 'Missing Values' AS category, CAST(n0 AS BIGINT) AS n, 'Filled using MEAN/MEDIAN/MODE' AS action FROM n
UNION ALL SELECT 'Duplicates', r0 - r1, 'Removed duplicate rows' FROM n
UNION ALL SELECT 'Outliers', (SELECT count(*) FROM single, f WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)),
  'Removed / capped using IQR method'
UNION ALL SELECT 'Data Types', 2, 'Converted to standard format'""")
def cleaning_report(t):
    steps = wizard.Wizard(dirty_lineitem(t))
    steps.apply("null_values")
    steps.apply("duplicates")
    typed = steps.apply("data_types")
    converted = len(steps.history[-1][3])  # as the step itself has decided
    found = stats.outlier_cells(typed).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("n")).first()["n"]
    return wizard.report(steps.lineage(), found, converted)


# ---- ad-hoc SQL ----------------------------------------------------------------------------------------

@query("sql_adhoc_topn", f"WITH {SALES_SQL} SELECT product, round(sum(sales), 4) AS total FROM sales_wide GROUP BY product ORDER BY 2 DESC, 1 LIMIT 5")
def sql_adhoc_topn(t):
    text = "SELECT product, round(sum(sales), 4) AS total FROM dataset GROUP BY product ORDER BY total DESC, product LIMIT 5"
    return adhoc.run_sql(sales_wide(t, ["product", "sales"]), text).rows()


@query("sql_month_group", f"WITH {SALES_SQL} SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS n, sum(quantity) AS quantity FROM sales_wide GROUP BY 1 ORDER BY 1 DESC")
def sql_month_group(t):
    text = """SELECT date_format(order_date, 'yyyy-MM') AS month, count(*) AS n, sum(quantity) AS quantity FROM dataset
              GROUP BY 1 ORDER BY month DESC"""
    return adhoc.run_sql(sales_wide(t, ["order_date", "quantity"]), text).rows()


@query("sql_qualify_topn", """SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def sql_qualify_topn(t):
    text = """SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
              PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM dataset) WHERE r <= 3"""
    return adhoc.run_sql(t.orders, text).rows()


@query("sql_date_diff", """SELECT l_returnflag, min(date_diff('day', o_orderdate, l_shipdate)) AS fastest,
  max(date_diff('day', o_orderdate, l_shipdate)) AS slowest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def sql_date_diff(t):
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    text = """SELECT l_returnflag, CAST(min(datediff(l_shipdate, o_orderdate)) AS BIGINT) AS fastest,
              CAST(max(datediff(l_shipdate, o_orderdate)) AS BIGINT) AS slowest FROM dataset GROUP BY l_returnflag"""
    return adhoc.run_sql(both, text).rows()


@query("sql_log_samples_filter", "SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1")
def sql_log_samples_filter(t):
    return adhoc.run_sql(t.orders, "SELECT year(o_orderdate) AS y, count(*) AS n FROM dataset WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1").rows()


@query("sql_log_samples_count", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def sql_log_samples_count(t):
    return adhoc.run_sql(t.part, "SELECT p_type, count(*) AS n FROM dataset GROUP BY p_type").rows()


@query("sql_log_samples_avg", "SELECT round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderdate > DATE '1998-01-01'")
def sql_log_samples_avg(t):
    return adhoc.run_sql(t.orders, "SELECT round(avg(o_totalprice), 4) AS mean FROM dataset WHERE o_orderdate > DATE '1998-01-01'").rows()


@query("sql_log_samples_sum", f"WITH {SALES_SQL} SELECT region, round(sum(sales), 4) AS revenue FROM sales_wide GROUP BY 1")
def sql_log_samples_sum(t):
    return adhoc.run_sql(sales_wide(t, ["region", "sales"]), "SELECT region, round(sum(sales), 4) AS revenue FROM dataset GROUP BY region").rows()


@query("sql_log_samples_distinct", "SELECT count(DISTINCT user_id) AS users FROM events")
def sql_log_samples_distinct(t):
    return adhoc.run_sql(t.events, "SELECT count(DISTINCT user_id) AS users FROM dataset").rows()


@query("sql_result_summary", """WITH k AS (SELECT o_custkey, o_orderpriority, o_totalprice FROM orders),
num AS (SELECT 'o_custkey' AS column_name, CAST(o_custkey AS DOUBLE) AS v FROM k UNION ALL SELECT 'o_totalprice', o_totalprice FROM k),
two AS (SELECT column_name, CAST(round(min(v), 2) AS DECIMAL(38, 2)) AS a, CAST(round(max(v), 2) AS DECIMAL(38, 2)) AS b,
  CAST(round(avg(v), 2) AS DECIMAL(38, 2)) AS c, CAST(round(sum(v), 2) AS DECIMAL(38, 2)) AS d FROM num GROUP BY 1)
SELECT column_name, 'min=' || a || ', max=' || b || ', mean=' || c || ', sum=' || d AS detail FROM two
UNION ALL SELECT 'o_orderpriority', (SELECT string_agg(o_orderpriority || '(' || n || ')', ', ' ORDER BY n DESC, o_orderpriority) FROM (
  SELECT o_orderpriority, count(*) AS n FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5))""")
def sql_result_summary(t):
    text = "SELECT o_custkey, o_orderpriority, o_totalprice FROM dataset"
    return adhoc.summary(adhoc.run_sql(t.orders, text))


@query("sql_multi_plan", f"""WITH {SALES_SQL} SELECT CAST(1 AS INTEGER) AS query_no, 'sales by region' AS question, count(*) AS total_rows, count(*) > 50 AS truncated,
  CAST(NULL AS VARCHAR) AS error FROM (SELECT region FROM sales_wide GROUP BY 1)
UNION ALL SELECT 2, 'sales by customer', count(*), count(*) > 50, NULL FROM (SELECT customer FROM sales_wide GROUP BY 1)
UNION ALL SELECT 3, 'remove everything', NULL, NULL, 'only SELECT statements are allowed'""")
def sql_multi_plan(t):
    wide = sales_wide(t, ["region", "customer", "sales"])
    return adhoc.run_plan(wide, [("sales by region", "SELECT region, sum(sales) AS s FROM dataset GROUP BY region"),
                                 ("sales by customer", "SELECT customer, sum(sales) AS s FROM dataset GROUP BY customer"),
                                 ("remove everything", "DELETE FROM dataset")], most_rows=50)
