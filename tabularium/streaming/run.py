"""Reading a table as a stream and draining a stream into the shared scratch folder."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tabularium.session import scratch_path
from tabularium.tables import Tables

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(t: Tables, name: str, batch_bytes: int = 64 << 30) -> DataFrame:
    """The Parquet table as a stream with the table's own schema, at most ``batch_bytes`` of files per micro-batch.

    The results of the operators do not depend on how files fall into micro-batches.
    """
    schema = getattr(t, name).schema
    pattern = f"{t.folder}/{name}.[p]arquet"  # as a pattern the table may be one file or a folder of files
    return t.spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(pattern)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Append the available rows to Parquet and read them back. Offsets and commits live next to the data."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    writer = (stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint")
              .outputMode("append").trigger(availableNow=True))
    with keyed_state(spark):
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start inside keep the state of ``transformWithState`` where it may outgrow memory, as that operator asks."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def drain_parts(stream: DataFrame, part: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Write ``part(micro-batch)`` under the batch's number, and read the parts of all batches back.

    A batch that is run again overwrites its own folder, so a restart does not double rows.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    schema = part(spark.createDataFrame([], stream.schema)).schema

    def keep(batch: DataFrame, number: int):
        part(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    spark.createDataFrame([], schema).write.parquet(f"{path}/data/batch=-1")
    (stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
           .trigger(availableNow=True).start().awaitTermination())
    return spark.read.option("basePath", f"{path}/data").schema(schema).parquet(f"{path}/data")


def append_log(df: DataFrame, path: str) -> None:
    """Append log rows to a Parquet log."""
    df.write.mode("append").parquet(path)
