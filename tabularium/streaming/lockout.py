"""Lockout state machine: repeated failures lock a key for a while.

Whether a failure counts depends on all earlier attempts of its key, but not across a success that follows the attempt before it by
the lock time or more: any lock is over then, the success is not refused, and the count is 0. Attempts are cut there into segments that know
nothing of each other, so one key's attempts are many tasks' work. Inside a segment the machine goes from lock to lock.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tabularium.session import written
from tabularium.streaming.run import drain_parts

# Failures before a lock, and its length.
FAILURES, LOCK_SECONDS = 3, 300

LOCKS = "user_id long, event_id long, failures int, until long"
ATTEMPTS = "user_id long, event_id long, us long, failed boolean"
ORDER = ("user_id", "us", "event_id", "failed")


def lockouts(stream: DataFrame, failures: int = FAILURES, lock_seconds: int = LOCK_SECONDS) -> DataFrame:
    """``stream``: (user_id, event_id, ts, failed). One row per lock, over everything that has arrived in any order."""
    return locks(drain_parts(stream.select("user_id", "event_id", "ts", "failed"), lambda batch: batch, "attempts"), failures, lock_seconds)


def locks(attempts: DataFrame, failures: int = FAILURES, lock_seconds: int = LOCK_SECONDS) -> DataFrame:
    """``user_id, event_id, failures, locked_until``: one row per lock of (user_id, event_id, ts, failed).

    While a key is locked its attempts are refused: they neither count nor reset. A success resets the count, a failure at or
    above the limit locks (again). Attempts without a time take no part; a null key is a key; a null outcome is a success. Ties
    go by event_id, then successes first.
    """
    if failures < 1:
        raise ValueError("failures must be at least 1")
    cut = segments(attempts, lock_seconds).repartition("segment").sortWithinPartitions("segment", *ORDER)
    return (cut.mapInArrow(machine(failures, lock_seconds * 1_000_000), LOCKS)
               .select("user_id", "event_id", "failures", F.timestamp_micros("until").cast("timestamp_ntz").alias("locked_until")))


def segments(attempts: DataFrame, lock_seconds: int = LOCK_SECONDS) -> DataFrame:
    """``segment, user_id, event_id, us, failed``: attempts with the segment that they belong to.

    One distributed order of all rows is cut by rows, not by keys. Cuts inside a partition need the row before only; whether a
    partition's head goes on with a segment of an earlier one is told by a summary with one row per partition.
    """
    named = attempts.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
                            F.coalesce("failed", F.lit(False)).alias("failed")).where("us IS NOT NULL")
    rows = written(named, "attempts")
    rows = written(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
                   .mapInArrow(blocks(lock_seconds * 1_000_000), f"{ATTEMPTS}, part int, block long"), "blocks")
    first, last = F.struct("user_id", "us", "failed"), F.struct("user_id", "us")
    parts = rows.groupBy("part").agg(F.min_by(first, F.struct(*ORDER)).alias("first"), F.max_by(last, F.struct(*ORDER)).alias("last"),
                                     F.max("block").alias("blocks"))
    by_part = W.orderBy("part")
    before = F.lag("last").over(by_part)
    joins = before.isNotNull() & F.col("first.user_id").eqNullSafe(before["user_id"]) & (
        F.col("first.failed") | (F.col("first.us") - before["us"] < lock_seconds * 1_000_000))
    # the head of a part belongs to the last block of the nearest earlier part that has a cut, or whose own head begins anew
    told = parts.withColumn("joins", F.coalesce(joins, F.lit(False)))
    ends = F.when(~F.col("joins") | (F.col("blocks") > 0), F.struct("part", F.col("blocks").alias("block")))
    owner = F.last(ends, ignorenulls=True).over(by_part.rowsBetween(W.unboundedPreceding, -1))
    heads = told.select("part", F.when(F.col("joins"), owner).otherwise(F.struct("part", F.lit(0).cast("long").alias("block"))).alias("head"))
    mine = F.when(F.col("block") == 0, F.col("head")).otherwise(F.struct("part", "block"))
    return rows.join(F.broadcast(heads), "part").select(mine.alias("segment"), "user_id", "event_id", "us", "failed")


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    user = batch.column("user_id")
    return {"user": pc.fill_null(user, 0).to_numpy(zero_copy_only=False), "none": user.is_null().to_numpy(zero_copy_only=False),
            "us": batch.column("us").to_numpy(zero_copy_only=False), "failed": batch.column("failed").to_numpy(zero_copy_only=False)}


def blocks(lock_us: int):
    """Task function over sorted attempts: numbers the blocks of its partition from 0, where the head has no cut of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, block = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _columns(batch)
            new = np.ones(batch.num_rows, bool)
            new[1:] = ((c["user"][1:] != c["user"][:-1]) | (c["none"][1:] != c["none"][:-1])
                       | ~c["failed"][1:] & (np.diff(c["us"]) >= lock_us))
            if last is None:
                new[0] = False
            else:
                new[0] = (c["user"][0], c["none"][0]) != last[:2] or (not c["failed"][0] and c["us"][0] - last[2] >= lock_us)
            number = block + np.cumsum(new)
            block, last = int(number[-1]), (c["user"][-1], c["none"][-1], c["us"][-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(number)],
                                             names=[*batch.schema.names, "part", "block"])

    return run


def run_through(us: np.ndarray, failed: np.ndarray, failures: int, lock_us: int, count: int = 0, until: int | None = None):
    """Locks ``(place, failures, until)`` of one segment's attempts, and the count and lock that it ends with.

    Goes from lock to lock: the next one is where the count reaches the limit, and what it refuses is skipped by its end.
    """
    n, out = len(us), []
    good = np.flatnonzero(~failed)
    # ends of all runs of failures that reach the limit by themselves
    inside = np.arange(n) - np.r_[-1, good][np.searchsorted(good, np.arange(n))]
    reach = np.flatnonzero(failed & (inside == failures))
    at = 0 if until is None else int(np.searchsorted(us, until))
    while at < n:
        g = int(np.searchsorted(good, at))
        stop = int(good[g]) if g < len(good) else n
        need = at + max(failures - count, 1) - 1  # failures go on from ``at``
        if need >= stop:
            if stop == n:
                return out, count + n - at, until
            # after a success the next run that reaches the limit begins and ends behind it
            r = int(np.searchsorted(reach, stop + failures))
            if r == len(reach):
                tail = n - 1 - int(good[-1])
                return out, tail, until
            need, count = int(reach[r]), failures
        else:
            count += need - at + 1
        until = int(us[need]) + lock_us
        out.append((need, count, until))
        at = max(need + 1, int(np.searchsorted(us, until)))
    return out, count, until


def machine(failures: int, lock_us: int):
    """Task function over attempts in (segment, time) order; looks into segments with enough failures only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, state = None, (0, None)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            c = _columns(batch)
            part, block = (batch.column("segment").field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.r_[0, np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1])) + 1, n]
            bad = np.add.reduceat(c["failed"].astype(np.int64), cuts[:-1])
            look = np.flatnonzero(bad >= failures).tolist()
            # the first may go on from the batch before, the last into the next
            look = sorted({0, len(cuts) - 2, *look})
            found = []
            for i in look:
                a, b = int(cuts[i]), int(cuts[i + 1])
                mark = (part[a], block[a])
                count, until = state if mark == segment else (0, None)
                locked, count, until = run_through(c["us"][a:b], c["failed"][a:b], failures, lock_us, count, until)
                found += [(a + place, k, end) for place, k, end in locked]
                if i == len(cuts) - 2:
                    segment, state = mark, (count, until)
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("user_id").take(at), batch.column("event_id").take(at),
                                              pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64())],
                                             names=["user_id", "event_id", "failures", "until"])

    return run
