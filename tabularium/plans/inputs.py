"""Two shared inputs: the wide sales table and a lineitem made dirty by key arithmetic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tabularium.tables import Tables

SALES_COLUMNS = (
    "order_key", "line_no", "part_key", "supp_key", "order_date", "sales", "quantity", "price",
    "product", "customer", "region", "segment", "profit",
)

SALES_SQL = """
sales_wide AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_no, l.l_partkey AS part_key, l.l_suppkey AS supp_key,
         o.o_orderdate AS order_date, l.l_extendedprice * (1 - l.l_discount) AS sales, l.l_quantity AS quantity,
         p.p_retailprice AS price, p.p_brand AS product, c.c_name AS customer, r.r_name AS region,
         c.c_mktsegment AS segment,
         l.l_extendedprice * (1 - l.l_discount) - l.l_quantity * p.p_retailprice AS profit
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)
"""


def net_sales() -> Column:
    return F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))


def sales_wide(t: Tables, columns: Iterable[str] = SALES_COLUMNS) -> DataFrame:
    """Line items with the order, customer and part attributes that ``columns`` asks for.

    Only the dimensions in use are joined: the foreign keys are total, so a dimension nobody reads would only
    add a shuffle. Join strategy is left to the size statistics and AQE (skewed keys are split there).
    """
    wanted = list(columns)
    want = set(wanted)
    df = t.lineitem
    if want & {"price", "product", "profit"}:
        df = df.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    if want & {"order_date", "customer", "region", "segment"}:
        orders = t.orders
        if want & {"customer", "region", "segment"}:
            people = t.customer
            if "region" in want:
                places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
                people = people.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    source = {
        "order_key": "l_orderkey", "line_no": "l_linenumber", "part_key": "l_partkey", "supp_key": "l_suppkey",
        "order_date": "o_orderdate", "quantity": "l_quantity", "price": "p_retailprice", "product": "p_brand",
        "customer": "c_name", "region": "r_name", "segment": "c_mktsegment",
    }
    made = {
        "sales": lambda: net_sales(),
        "profit": lambda: net_sales() - F.col("l_quantity") * F.col("p_retailprice"),
    }
    return df.select(*[made[c]().alias(c) if c in made else F.col(source[c]).alias(c) for c in wanted])


DIRTY_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "quantity", "price", "discount", "flag", "note",
    "qty_text", "date_text", "currency",
)

DIRTY_SQL = """
dirty AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity,
         CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price,
         l_discount + 0.0 AS discount,
         CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN '  ' || l_returnflag || ' '
              ELSE l_returnflag END AS flag,
         CASE WHEN l_orderkey % 10 = 0 THEN l_linestatus END AS note,
         CASE WHEN l_partkey % 12 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty_text,
         CASE WHEN l_partkey % 6 = 0 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date_text,
         'USD' AS currency
  FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 50 = 0))
"""


def dirty_lineitem(t: Tables) -> DataFrame:
    """Line items with nulls, padded flags, a mostly empty column, bad numbers and dates, outliers and repeats."""
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    copies = F.when(key % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(key % 7 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(key % 997 == 0, F.col("l_extendedprice") * 20).otherwise(F.col("l_extendedprice")).alias("price"),
        (F.col("l_discount") + F.lit(0.0)).alias("discount"),
        F.when(part % 5 == 0, F.lit(None))
        .when(key % 3 == 0, F.concat(F.lit("  "), "l_returnflag", F.lit(" ")))
        .otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(key % 10 == 0, F.col("l_linestatus")).alias("note"),
        F.when(part % 12 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("bigint").cast("string"))
        .alias("qty_text"),
        F.when(part % 6 == 0, F.lit("unknown")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("date_text"),
        F.lit("USD").alias("currency"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def sales_by_part(t: Tables) -> DataFrame:
    """Sales, quantity and profit per part, summed before the part attributes are joined on.

    The sums run map-side, so a part that holds a large share of all lines is one row per task before any shuffle.
    """
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum(net_sales()).alias("sales"), F.sum("l_quantity").alias("quantity"))
    return per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("product"), "sales", "quantity",
        (F.col("sales") - F.col("quantity") * F.col("p_retailprice")).alias("profit"))


def sales_by_order(t: Tables) -> DataFrame:
    """Sales and quantity per order with its date and customer key; the sum and the join share one partitioning."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(net_sales()).alias("sales"), F.sum("l_quantity").alias("quantity"))
    return per_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("order_date"), F.col("o_custkey").alias("cust_key"), "sales", "quantity")


def sales_by_customer(t: Tables) -> DataFrame:
    """Sales and quantity per customer with name, segment and region."""
    per_customer = sales_by_order(t).groupBy("cust_key").agg(F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity"))
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (per_customer.join(t.customer, F.col("cust_key") == F.col("c_custkey"))
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment"),
                    F.col("r_name").alias("region"), "sales", "quantity"))
