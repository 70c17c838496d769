"""Database tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, partition_on: str | None = None, low=None, high=None,
               partitions: int = 32, cap: int | None = None, **options: str) -> DataFrame:
    """A table, read in ``partitions`` ranges of a numeric or date column; filters and limits are pushed down."""
    settings = {"url": url, "dbtable": table, "fetchsize": "10000", **options}
    if partition_on:
        settings |= {"partitionColumn": partition_on, "lowerBound": str(low), "upperBound": str(high),
                     "numPartitions": str(partitions)}
    df = spark.read.format("jdbc").options(**settings).load()
    return df.limit(cap) if cap else df


def list_tables(spark: SparkSession, url: str, schema: str, **options: str) -> DataFrame:
    """Table names of a schema, from the standard catalog view."""
    text = f"(SELECT table_name FROM information_schema.tables WHERE table_schema = '{schema.replace(chr(39), '')}') t"
    return spark.read.format("jdbc").options(url=url, dbtable=text, **options).load()
