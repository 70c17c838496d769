"""Structured Streaming forms of the event-time operators.

Each micro-batch is reduced to mergeable partial rows (counts per window, runs of events, first rows per key), which are
written under the batch's number; the result merges the parts of all batches. Nothing waits behind a watermark, so rows may
arrive in any order and however late, none is dropped, and sessions still open are there as far as they go. A batch that
runs again overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabularium.operators import sequences
from tabularium.streaming.run import drain_parts


def _plain(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def busy_windows(stream: DataFrame, key: str, moment: str, width: str) -> DataFrame:
    """``(key, window_start, hits)``: hits per key and fixed window over everything that has arrived."""

    def part(batch: DataFrame) -> DataFrame:
        return (batch.groupBy(key, F.window(moment, width).alias("w")).agg(F.count(F.lit(1)).alias("hits"))
                .select(key, _plain(F.col("w.start")).alias("window_start"), "hits"))

    return drain_parts(stream, part, "windows").groupBy(key, "window_start").agg(F.sum("hits").alias("hits"))


def idle_sessions(stream: DataFrame, key: str, moment: str, idle_seconds: int = 7200) -> DataFrame:
    """``(key, session_start, session_end, events)``: sessions of everything that has arrived, open ones included."""
    runs = drain_parts(stream, lambda batch: sequences.session_runs(batch, key, moment, idle_seconds), "sessions")
    return sequences.joined_runs(runs, key, idle_seconds)


def once(stream: DataFrame, keys: list[str], moment: str) -> DataFrame:
    """The earliest row per key, however far apart its copies arrive; the smallest other values on ties."""
    rest = [c for c in stream.columns if c not in keys and c != moment]

    def first(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.min(F.struct(moment, *rest)).alias("_row"))
        return found.select(*keys, "_row.*").select(*stream.columns)

    return first(drain_parts(stream, first, "once"))
