"""Streams whose results come out while they run."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabularium.streaming import live, run

DAY = dt.datetime(2024, 1, 1)
IDLE = dt.timedelta(hours=2)


def batches_of(spark, path, files, schema, made, horizon):
    """What a query emits per micro-batch when the files are there one after another."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/data")
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/data")
    out = collections.defaultdict(list)
    writer = (made(feed, horizon).writeStream.foreachBatch(lambda df, i: out[i].extend(tuple(r) for r in df.collect()))
              .option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True))
    with run.keyed_state(spark):
        query = writer.start()
    query.awaitTermination()
    return [out[i] for i in range(max(out, default=-1) + 1)]


def sessions(feed, horizon):
    return live.closed_sessions(feed, "who", "at", 7200, horizon)


def left(emitted):
    net = collections.Counter()
    for batch in emitted:
        for *row, change in batch:
            net[tuple(row)] += change
    assert set(net.values()) <= {0, 1}
    return {r for r, n in net.items() if n}


def plain(rows):
    """Sessions that ended more than the idle time before the newest event."""
    newest, out = max(at for _, at in rows), set()
    for who in {w for w, _ in rows}:
        times = sorted(at for w, at in rows if w == who)
        start = last = times[0]
        n = 0
        for at in [*times, None]:
            if at is None or at - last >= IDLE:
                if last + IDLE < newest:
                    out.add((who, start, last, n))
                start, n = at, 0
            last, n = at, n + 1
    return out


def test_sessions_leave_as_they_close_and_late_rows_alter_them(spark, tmp_path):
    hour = lambda h: DAY + dt.timedelta(hours=h)
    files = [[("a", hour(0)), ("a", hour(1)), ("b", hour(0))],
             [("c", hour(5))],
             [("c", hour(6))],                       # a and b have closed by now though they have no more rows
             [("a", hour(2.5)), (None, hour(1))],    # late: a was not over
             [("c", hour(9))]]
    out = batches_of(spark, tmp_path, files, "who string, at timestamp_ntz", sessions, dt.timedelta(days=30))
    first = ("a", hour(0), hour(1), 2, 1)
    assert out[:2] == [[], []] and sorted(out[2]) == [first, ("b", hour(0), hour(0), 1, 1)]
    assert [r for batch in out for r in batch if r[0] == "a"] == [first, ("a", hour(0), hour(1), 2, -1), ("a", hour(0), hour(2.5), 3, 1)]
    assert left(out) == plain([r for f in files for r in f])


@pytest.mark.parametrize("order", ["time", "mixed", "backward"])
def test_what_is_left_does_not_depend_on_the_order_of_files(spark, tmp_path, order):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["x", "y", None]), DAY + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 6))) for _ in range(400)]
    rows.sort(key=lambda r: r[1], reverse=order == "backward")
    files = [rows[i::5] for i in range(5)] if order == "mixed" else [rows[i * 80:i * 80 + 80] for i in range(5)]
    out = batches_of(spark, tmp_path, files, "who string, at timestamp_ntz", sessions, dt.timedelta(days=30))
    assert left(out) == plain(rows) and len(left(out)) > 10
    assert any(r[-1] == -1 for batch in out for r in batch) == (order != "time") or order == "backward"


def test_state_is_given_up_beyond_the_horizon(spark, tmp_path):
    hour = lambda h: DAY + dt.timedelta(hours=h)
    files = [[("a", hour(0))], [("c", hour(50))], [("c", hour(60))], [("a", hour(1))], [("c", hour(61))]]
    out = batches_of(spark, tmp_path, files, "who string, at timestamp_ntz", sessions, dt.timedelta(hours=10))
    assert [r for batch in out for r in batch if r[0] == "a"] == [("a", hour(0), hour(0), 1, 1)]  # the last row of a is too late


def test_tokens_expire_and_are_renewed(spark, tmp_path):
    day = lambda d: DAY + dt.timedelta(days=d)
    files = [[(1, day(0), day(3)), (2, day(0), day(9)), (3, day(0), None)], [(4, day(5), day(8))], [(3, day(5), None)], [(1, day(2), day(4)), (1, day(2), day(6))], [(5, day(7), None)]]
    tokens = lambda feed, horizon: live.expired_tokens(feed, "id", "at", "ends", horizon)
    out = batches_of(spark, tmp_path, files, "id long, at timestamp_ntz, ends timestamp_ntz", tokens, dt.timedelta(days=30))
    assert [r for batch in out for r in batch] == [(1, day(3), 1), (1, day(3), -1), (1, day(6), 1)]
    assert left(out) == {(1, day(6))}


def test_no_rows(spark, tmp_path):
    feed = lambda: spark.readStream.schema("who string, at timestamp_ntz").parquet(str(tmp_path / "none*"))
    assert live.settled(run.drain(sessions(feed(), dt.timedelta(days=1)), "none")).collect() == []


class Counted:
    """State and timers of one key, and how often they are used."""

    def __init__(self):
        self.state, self.calls, self.timers = None, 0, []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.state

    def update(self, value):
        self.calls, self.state = self.calls + 1, value

    def clear(self):
        self.calls, self.state = self.calls + 1, None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)

    def getExpiryTimeInMs(self):
        return self.timers[-1]

    def getCurrentWatermarkInMs(self):
        return 10**9


def test_a_key_of_many_sessions_uses_its_state_a_few_times():
    import pandas as pd
    made, held = live.ClosedSessions("who", 7_200_000_000, 10**18), Counted()
    made.init(held)
    starts = [i * 10**10 for i in range(2000)]
    runs = pd.DataFrame({"first": starts, "last": starts, "n": 1})
    assert list(made.handleInputRows(("a",), iter([runs]), held)) == [] and len(held.timers) == 1
    out = list(made.handleExpiredTimer(("a",), held, held))
    assert [len(o) for o in out] == [2000] and held.calls < 10
