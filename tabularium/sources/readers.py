"""Reader registry: a source name picks ``fn(spark, **options) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabularium.sources import database, files, pages

READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": files.read_csv,
    "csv_text": files.read_csv_text,
    "csv_raw": files.load_raw,
    "json": files.read_json_rows,
    "records": pages.records,
    "properties": pages.properties,
    "typed_properties": pages.typed_properties,
    "jdbc": database.read_table,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def read(spark: SparkSession, source: str, **options) -> DataFrame:
    if source not in READERS:
        raise ValueError(f"unknown source {source}; known: {', '.join(sorted(READERS))}")
    return READERS[source](spark, **options)
