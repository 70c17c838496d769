"""Results that come out while a stream runs: sessions as they close, tokens as they expire.

Rows leave as changes: ``change`` 1 puts a row into the result, -1 takes it out again when late rows have altered it. Time is the newest
event time seen, so a closed session leaves in the micro-batch after the one that moved time past its end, whether or not its key
has any more rows. Rows may come in any order within ``horizon``; only then is their state given up, and rows later than that are
dropped. To have both, the watermark trails the newest event by the horizon, and timers are set earlier by as much.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HORIZON = timedelta(days=30)
#: A row that gives its token no end, in microseconds.
NEVER = -(1 << 62)


def _ms(us: int) -> int:
    return us // 1000


class ClosedSessions(StatefulProcessor):
    """Sessions of one key: those still open, and those that left but may yet be altered.

    They are one value, rows of (start, end, events, out) in time order, and a key has one timer at a time: a micro-batch
    reads and writes the state of each key that it concerns once, however many sessions come, close or are forgotten.
    """

    def __init__(self, key: str, idle_us: int, horizon_us: int):
        self.key, self.idle, self.horizon = key, idle_us, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", "packed binary, timer long")

    def close(self) -> None:
        pass

    def held(self) -> tuple[np.ndarray, int | None]:
        """The sessions of this key and when its timer rings."""
        state = self.sessions.get()
        if state is None:
            return np.empty((0, 4), np.int64), None
        return np.frombuffer(state[0], np.int64).reshape(-1, 4), state[1]

    def due(self, sessions: np.ndarray) -> np.ndarray:
        """When something happens to each session, in milliseconds: one that is in leaves, one that is out is forgotten."""
        return (sessions[:, 1] + self.idle - np.where(sessions[:, 3] == 0, self.horizon, 0)) // 1000

    def keep(self, sessions: np.ndarray, timer: int | None) -> None:
        """Writes the state; the timer is set unless an earlier one is."""
        if not len(sessions):
            self.sessions.clear()
            return
        first = int(self.due(sessions).min())
        if timer is None or first < timer:
            self.handle.registerTimer(first)
            timer = first
        self.sessions.update((sessions.astype(np.int64).tobytes(), timer))

    def rows(self, key, found: np.ndarray, change: int) -> pd.DataFrame:
        """Changes (start, end, events, change) of one key."""
        out = pd.DataFrame({"start_us": found[:, 0], "end_us": found[:, 1], "events": found[:, 2], "change": np.full(len(found), change, np.int32)})
        out.insert(0, self.key, pd.Series([key] * len(out), dtype=object))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Joins new runs of events with the sessions that they touch; a session that had left is taken back."""
        new = np.concatenate([r[["first", "last", "n"]].to_numpy(np.int64) for r in rows])
        held, timer = self.held()
        runs = np.concatenate([np.column_stack([new, np.full(len(new), -1)]), held])  # -1: not a session yet
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        ends = np.maximum.accumulate(runs[:, 1])
        starts = np.flatnonzero(np.concatenate([[True], runs[1:, 0] - ends[:-1] >= self.idle]))
        fresh = np.logical_or.reduceat(runs[:, 3] < 0, starts)
        joined = np.column_stack([runs[starts, 0], np.maximum.reduceat(runs[:, 1], starts), np.add.reduceat(runs[:, 2], starts),
                                  np.where(fresh, 0, runs[starts, 3])])
        of = np.repeat(fresh, np.diff(np.append(starts, len(runs))))
        taken = runs[of & (runs[:, 3] == 1)]
        self.keep(joined, timer)
        if len(taken):
            yield self.rows(key[0], taken, -1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Lets go of sessions that no event in time order can reach, and forgets those that no late one can."""
        now, (sessions, timer) = timerValues.getCurrentWatermarkInMs(), self.held()
        if not len(sessions):
            return
        sessions = sessions.copy()
        closed = (sessions[:, 3] == 0) & (self.due(sessions) < now)
        sessions[closed, 3] = 1
        rang = expiredTimerInfo.getExpiryTimeInMs()
        self.keep(sessions[(sessions[:, 3] == 0) | (self.due(sessions) >= now)], None if timer is None or rang >= timer else timer)
        if closed.any():
            yield self.rows(key[0], sessions[closed], 1)


def runs(idle_us: int, key: str):
    """Task function: the events of each key that lie in one slot as wide as the idle time, as one run."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us = batch.column("us")
            slot = pa.array(np.floor_divide(us.to_numpy(zero_copy_only=False), idle_us))
            t = pa.table({key: batch.column(key), "slot": slot, "us": us}).group_by([key, "slot"]).aggregate([("us", "min"), ("us", "max"), ("us", "count")])
            columns = [t.column(key), t.column("us_min"), t.column("us_max"), t.column("us_count")]
            yield from pa.table(columns, names=[key, "first", "last", "n"]).to_batches()
    return make


def _changes(df: DataFrame, key: str) -> DataFrame:
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return df.select(key, at("start_us").alias("session_start"), at("end_us").alias("session_end"), "events", "change")


def closed_sessions(stream: DataFrame, key: str, moment: str, idle_seconds: int = 7200, horizon: timedelta = HORIZON) -> DataFrame:
    """``key, session_start, session_end, events, change`` as a running stream; a gap of ``idle_seconds`` or more ends a session.

    Tasks reduce their rows to runs before the shuffle, so a key's share of the rows does not matter. A session has closed
    when the newest event is more than ``idle_seconds`` (in whole milliseconds) behind its end. Rows without a time take no part.
    """
    idle, span = idle_seconds * 1_000_000, horizon // timedelta(microseconds=1)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.unix_micros(F.col(moment).cast("timestamp")).alias("us")).where("us IS NOT NULL")
    parts = rows.mapInArrow(runs(idle, key), f"`{key}` {kind}, first long, last long, n long").withColumn("_at", F.timestamp_micros("last"))
    made = (parts.withWatermark("_at", f"{span // 1000} milliseconds").groupBy(key)
            .transformWithStateInPandas(ClosedSessions(key, idle, span), f"`{key}` {kind}, start_us long, end_us long, events long, change int", "Append", "EventTime"))
    return _changes(made, key)


class ExpiredTokens(StatefulProcessor):
    """When one token expires; the latest of its rows tells."""

    def __init__(self, key: str, horizon_us: int):
        self.key, self.horizon = key, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.token = handle.getValueState("token", "expires long, out boolean")

    def close(self) -> None:
        pass

    def row(self, key, expires: int, change: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key], dtype=object), "expires": [expires], "change": [change]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A renewal moves the end, also of a token that was thought to have expired."""
        expires = int(max(r["expires"].max() for r in rows))
        held = self.token.get()
        if expires == NEVER or held is not None and expires <= held[0]:
            return
        if held is not None and held[1]:
            yield self.row(key[0], held[0], -1)
        self.token.update((expires, False))
        self.handle.registerTimer(_ms(expires - self.horizon))
        self.handle.registerTimer(_ms(expires))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self.token.get()
        if held is None:
            return
        if not held[1] and _ms(held[0] - self.horizon) < now:
            self.token.update((held[0], True))
            yield self.row(key[0], held[0], 1)
        if _ms(held[0]) < now:
            self.token.clear()


def latest(key: str):
    """Task function: each token's latest end and newest row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by([key]).aggregate([("us", "max"), ("expires", "max")])
            yield from t.select([key, "us_max", "expires_max"]).rename_columns([key, "us", "expires"]).to_batches()
    return make


def expired_tokens(stream: DataFrame, key: str, moment: str, expires: str, horizon: timedelta = HORIZON) -> DataFrame:
    """``key, expires_at, change`` as a running stream: tokens whose last end lies before the newest ``moment`` (in whole
    milliseconds). Rows that repeat a token renew it: the latest end counts. Rows without an end only move time on, rows
    without a time take no part."""
    span = horizon // timedelta(microseconds=1)
    kind = stream.schema[key].dataType.simpleString()
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = stream.select(key, micros(moment).alias("us"), F.coalesce(micros(expires), F.lit(NEVER)).alias("expires")).where("us IS NOT NULL")
    parts = rows.mapInArrow(latest(key), f"`{key}` {kind}, us long, expires long").withColumn("_at", F.timestamp_micros("us"))
    made = (parts.withWatermark("_at", f"{span // 1000} milliseconds").groupBy(key)
            .transformWithStateInPandas(ExpiredTokens(key, span), f"`{key}` {kind}, expires long, change int", "Append", "EventTime"))
    return made.select(key, F.timestamp_micros("expires").cast("timestamp_ntz").alias("expires_at"), "change")


def settled(changes: DataFrame) -> DataFrame:
    """The rows that the changes so far leave."""
    columns = [c for c in changes.columns if c != "change"]
    return changes.groupBy(*columns).agg(F.sum("change").alias("_left")).where("_left > 0").drop("_left")
