"""Writing results: files, JSON artifacts, versioned states, keyed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabularium.operators import clean


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; the commit protocol makes the folder appear as a whole."""
    df.write.mode("overwrite").json(path)


def snapshot(frames: dict[str, DataFrame], path: str) -> None:
    """Every table, every row, one Parquet folder per table."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the newest version per key; kept by a partial aggregate, so hot keys are no problem."""
    return clean.dedup(old.unionByName(new), "last", keys, [version])


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Set columns on the rows that match."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")
