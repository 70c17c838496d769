"""Streams against plain loops and against the batch operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import sequences
from tabularium.streaming import lockout, run, windows
from tabularium.tables import Tables


def make_events(spark, path, parts=6):
    """Attempts, one file per part in no order of time; user 1 has most of them, many in one hour."""
    rng = random.Random(11)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(900):
        start += dt.timedelta(seconds=rng.choice([1, 20, 70, 400, 9000]))
        rows.append((i, start, 1 if rng.random() < 0.6 else rng.randint(2, 5), "error" if rng.random() < 0.6 else "view", 1.0, "{}"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    shuffled = rng.sample(rows, len(rows))
    for p in range(parts):
        spark.createDataFrame(shuffled[p::parts], schema).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return rows


BATCHES = (1, 64 << 30)  # one file per micro-batch, and everything in one


def test_lockouts_match_a_plain_loop(spark, tmp_path):
    rows = make_events(spark, tmp_path)
    want, count, until = set(), {}, {}
    for event, ts, user, kind, _, _ in rows:
        if ts < until.get(user, dt.datetime.min):
            continue
        count[user] = count.get(user, 0) + 1 if kind == "error" else 0
        if count[user] >= 3:
            until[user] = ts + dt.timedelta(minutes=5)
            want.add((user, event, count[user], until[user]))
    t = Tables(spark, str(tmp_path))
    for batch_bytes in BATCHES:
        feed = run.table_stream(t, "events", batch_bytes).select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
        got = lockout.lockouts(feed).collect()
        assert {(r["user_id"], r["event_id"], r["failures"], r["locked_until"]) for r in got} == want and want


def plain_locks(us, failed, failures, lock, count=0, until=None):
    out = []
    for i, (at, bad) in enumerate(zip(us, failed)):
        if until is not None and at < until:
            continue
        count = count + 1 if bad else 0
        if count >= failures:
            until = at + lock
            out.append((i, count, until))
    return out, count, until


def test_machine_goes_from_lock_to_lock_as_a_plain_loop():
    rng = random.Random(5)
    for _ in range(4000):
        us = np.sort(np.array([rng.randint(0, 30) for _ in range(rng.randint(0, 14))], np.int64))
        failed = np.array([rng.random() < 0.7 for _ in us], bool)
        how = (rng.randint(1, 4), rng.randint(1, 8), rng.randint(0, 5), rng.choice([None, rng.randint(0, 10)]))
        assert lockout.run_through(us, failed, *how) == plain_locks(us.tolist(), failed.tolist(), *how)


def hot_attempts(seed, n=6000):
    """Nine of ten attempts are one user's, in bursts with quiet times between them; some have no user, no time or no outcome."""
    rng = random.Random(seed)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(n):
        start += dt.timedelta(seconds=rng.choice([0, 1, 20, 70, 299, 300, 400, 4000]))
        user = 1 if rng.random() < 0.9 else rng.choice([None, 2, 3])
        rows.append((i // 2, None if rng.random() < 0.01 else start, user, rng.choice([True, True, False, None])))
    return rows


@pytest.mark.parametrize("batch_rows", [10_000, 7])
def test_a_hot_user_is_many_segments(spark, batch_rows):
    rows = hot_attempts(batch_rows)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "event_id long, ts timestamp_ntz, user_id long, failed boolean").repartition(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = sorted((r.user_id or 0, r.event_id, r.failures, r.locked_until) for r in lockout.locks(df).collect())
        cut = lockout.segments(df)
        hot = cut.where("user_id = 1").groupBy("segment").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
        tasks = cut.repartition("segment").where("user_id = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for user in {r[2] for r in rows}:
        mine = sorted((ts, event, bool(bad)) for event, ts, u, bad in rows if u == user and ts is not None)
        found, _, _ = plain_locks([m[0] for m in mine], [m[2] for m in mine], 3, dt.timedelta(minutes=5))
        want += [(user or 0, mine[i][1], k, until) for i, k, until in found]
    assert got == sorted(want) and len(want) > 100
    assert hot.n > 100 and hot.most < 300 and tasks > 1


def test_a_segment_may_run_through_many_partitions(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i), 1, i % 5 != 4) for i in range(2000)] + [(5000, start, 2, False)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, failed boolean").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        cut = lockout.segments(df)
        assert cut.select("segment").distinct().count() == 2 and cut.count() == 2001
        got = sorted((r.event_id, r.failures, r.locked_until) for r in lockout.locks(df).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found, _, _ = plain_locks([r[1] for r in rows[:2000]], [r[3] for r in rows[:2000]], 3, dt.timedelta(minutes=5))
    assert got == found
    assert lockout.locks(df.where("false")).collect() == []


def test_windows_equal_batch(spark, tmp_path):
    make_events(spark, tmp_path)
    t = Tables(spark, str(tmp_path))
    batch = {tuple(r) for r in sequences.busy_windows(t.events, "user_id", "ts", "10 minutes", 1).collect()}
    for batch_bytes in BATCHES:
        assert {tuple(r) for r in windows.busy_windows(run.table_stream(t, "events", batch_bytes), "user_id", "ts", "10 minutes").collect()} == batch


def test_sessions_equal_batch_and_a_plain_loop(spark, tmp_path):
    rows = make_events(spark, tmp_path)
    want, last = {}, {}
    for _, ts, user, _, _, _ in rows:
        if user not in last or ts - last[user][1] >= dt.timedelta(hours=2):
            last[user] = [ts, ts, 0]
            want.setdefault(user, []).append(last[user])
        last[user][1] = ts
        last[user][2] += 1
    want = {(u, *s) for u, found in want.items() for s in found}
    t = Tables(spark, str(tmp_path))
    assert {tuple(r) for r in sequences.sessions(t.events, "user_id", "ts").collect()} == want
    for batch_bytes in BATCHES:
        assert {tuple(r) for r in windows.idle_sessions(run.table_stream(t, "events", batch_bytes), "user_id", "ts").collect()} == want


def test_repeats_are_dropped(spark, tmp_path):
    rows = make_events(spark, tmp_path)
    t = Tables(spark, str(tmp_path))
    for batch_bytes in BATCHES:
        twice = run.table_stream(t, "events", batch_bytes).union(run.table_stream(t, "events", batch_bytes))
        assert windows.once(twice, ["event_id"], "ts").count() == len(rows)
