"""Nested page dumps of web services as flat rows. Each input line is one page of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F



def records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Pages ``{"records": [{"id", "fields": {…}}]}`` as ``_airtable_id`` and the fields."""
    pages = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    return pages.select(F.explode("records").alias("r")).select(F.col("r.id").alias("_airtable_id"), "r.fields.*")


def properties(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Pages ``{"results": [{"id", "properties": {…}}]}`` as ``_hubspot_id`` and the properties."""
    pages = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    return pages.select(F.explode("results").alias("r")).select(F.col("r.id").alias("_hubspot_id"), "r.properties.*")


# The property kinds of a typed page and the shape of their values.
TYPED_PAGE = """results array<struct<id string, properties map<string, struct<type string,
  title array<struct<plain_text string>>, rich_text array<struct<plain_text string>>, number double, checkbox boolean,
  url string, email string, phone_number string, select struct<name string>, multi_select array<struct<name string>>,
  date struct<start string>, people array<struct<name string>>>>>>"""


def _plain_value(p):
    """One typed property as text."""
    kind = p["type"]
    joined = lambda items, part, sep: F.array_join(F.transform(items, lambda x: x[part]), sep)
    return (F.when(kind == "title", joined(p["title"], "plain_text", " "))
            .when(kind == "rich_text", joined(p["rich_text"], "plain_text", " "))
            .when(kind == "number", p["number"].cast("string")).when(kind == "checkbox", p["checkbox"].cast("string"))
            .when(kind == "url", p["url"]).when(kind == "email", p["email"]).when(kind == "phone_number", p["phone_number"])
            .when(kind == "select", p["select"]["name"]).when(kind == "multi_select", joined(p["multi_select"], "name", ", "))
            .when(kind == "date", p["date"]["start"]).when(kind == "people", joined(p["people"], "name", ", ")))


def typed_properties(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Typed pages as ``id`` and one text column per property name.

    The names are found once (a short distinct list); each row then picks its own values, without a shuffle.
    """
    rows = spark.read.schema(TYPED_PAGE).json(path).select(F.explode("results").alias("r")).select("r.id", "r.properties")
    if names is None:
        found = rows.select(F.explode(F.map_keys("properties")).alias("name")).distinct().orderBy("name")
        names = [r["name"] for r in found.collect()]  # one per output column
    return rows.select("id", *[_plain_value(F.element_at("properties", F.lit(n))).alias(n) for n in names])


def report_rows(df: DataFrame, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """Rows of ``dimension_values[].value`` and ``metric_values[].value`` as named columns, by position."""
    at = lambda c, i: F.element_at(F.col(c), i + 1)["value"]
    return df.select(F.explode("rows").alias("r")).select("r.*").select(
        *[at("dimension_values", i).alias(n) for i, n in enumerate(dimensions)],
        *[at("metric_values", i).cast("double").alias(n) for i, n in enumerate(metrics)])
