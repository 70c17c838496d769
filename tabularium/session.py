"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def build_session(app: str = "tabularium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    Partition counts stay with the cluster: AQE coalesces small shuffle partitions and splits skewed ones,
    so only local runs need an explicit count.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, one in the session's default file system.

    A default file system that is each machine's own disk serves local mode only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    fs, place = file_system(spark, "/tmp/checkpoints")
    if fs.getScheme() == "file" and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return fs.makeQualified(place).toString()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared scratch folder, deleted when this program ends."""
    path = f"{scratch_root(spark)}/tabularium/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the scratch folder and read again, for frames that several others are made of."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    fs, place = file_system(spark, path)
    fs.delete(place, True)


@atexit.register
def clean_scratch() -> None:
    """Deletes the scratch folders of this program; frames that still read them stop working."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            delete(spark, path)
        except Exception:  # the JVM may have ended before
            return
