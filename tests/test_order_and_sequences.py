import datetime as dt
import random

import pytest
from pyspark.sql import Window as W, functions as F

from tabularium.operators import ordering, sequences


@pytest.fixture(scope="module")
def shuffled(spark):
    return spark.range(1000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("g"),
                                    F.when(F.col("id") % 4 != 1, F.col("id") * 1.0).alias("x")).repartition(7)


def test_positions_are_a_permutation(shuffled):
    rows = ordering.with_position(shuffled, ["g", "id"]).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(1000))
    assert [(r["g"], r["id"]) for r in rows] == sorted((r["g"], r["id"]) for r in rows)


def test_running_sum(shuffled):
    rows = ordering.with_running_sum(shuffled, ["g", "id"], "id").orderBy("g", "id").collect()
    total = 0
    for r in rows:
        total += r["id"]
        assert r["upto"] == total


@pytest.mark.parametrize("forward", [True, False])
def test_fill_along_equals_window(shuffled, forward):
    got = {r["id"]: r["x"] for r in ordering.fill_along(shuffled, "x", ["id"], forward).collect()}
    w = W.orderBy(F.col("id") if forward else F.desc("id"))
    want = {r["id"]: r["y"] for r in shuffled.withColumn("y", F.last("x", ignorenulls=True).over(w)).collect()}
    assert got == want


def test_split_and_pages(shuffled):
    second = ordering.split_after(shuffled.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), "ts", ["id"])
    marked = shuffled.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("second", second)
    assert [r["id"] for r in marked.filter("second").orderBy("id").collect()] == list(range(500, 1000))
    shallow = ordering.page(shuffled, ["id"], 4, 10).collect()
    deep = ordering.page(shuffled, ["id"], 4, 10, shallow=0).collect()
    assert [r["id"] for r in shallow] == [r["id"] for r in deep] == list(range(30, 40))
    assert ordering.page(shuffled, ["id"], 1, None).count() == 1000
    picked = ordering.every_nth(shuffled, ["id"], 100).collect()
    assert sorted(r["id"] for r in picked) == list(range(0, 1000, 10))


@pytest.fixture(scope="module")
def clicks(spark):
    """One key holds two thirds of the rows, over several days with quiet nights."""
    base = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 11).alias("user_id"),
                                    (F.pmod(F.xxhash64("id"), F.lit(9 * 86400))).alias("s"))
    return base.select("event_id", "user_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)"))).alias("ts"),
                       (F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(10)) < 8).alias("bad"))


def plain_sessions(df, gap):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["user_id"], r["ts"])):
        runs = out.setdefault(r["user_id"], [])
        if runs and (r["ts"] - runs[-1][1]).total_seconds() < gap:
            runs[-1][1] = r["ts"]
            runs[-1][2] += 1
        else:
            runs.append([r["ts"], r["ts"], 1])
    return {(u, *run) for u, runs in out.items() for run in runs}


@pytest.mark.parametrize("gap", [120, 900, 7200, 100_000])
def test_sessions_match_a_plain_loop(clicks, gap):
    got = {(r["user_id"], r["session_start"], r["session_end"], r["events"]) for r in sequences.sessions(clicks, "user_id", "ts", gap).collect()}
    assert got == plain_sessions(clicks, gap)


def test_failure_runs_match_a_plain_loop(clicks):
    want, state = {}, {}
    for r in sorted(clicks.collect(), key=lambda r: (r["ts"], r["event_id"])):
        state[r["user_id"]] = state.get(r["user_id"], 0) + 1 if r["bad"] else 0
        want[r["event_id"]] = state[r["user_id"]]
    got = {r["event_id"]: r["run"] for r in sequences.failure_runs(clicks, "user_id", "ts", "event_id", F.col("bad")).collect()}
    assert got == want


def test_last_rows_limits_before_the_shuffle(clicks):
    df = sequences.last_rows(clicks, "user_id", ["ts", "event_id"], 12)
    assert df.groupBy("user_id").count().agg(F.max("count")).first()[0] == 12
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_many_copies_of_one_row_are_split(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_PART_ROWS", 5_000)
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    parts = ordering.ordered_slots(df, ["k"]).groupBy("_part").count().collect()
    assert len(parts) == 6 and max(r["count"] for r in parts) < 8_000
    rows = ordering.with_position(df, ["k"]).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(30_000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_empty_frames_have_no_positions(spark):
    empty = spark.range(0).withColumn("x", F.col("id") * 1.0)
    assert ordering.with_position(empty, ["id"]).count() == 0
    assert ordering.fill_along(empty, "x", ["id"]).count() == 0


def test_sessions_see_a_row_per_slot_only(clicks):
    """The rows of a key are summed per time slot before any window, below the shuffle."""
    runs = sequences.session_runs(clicks, "user_id", "ts")
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("HashAggregate") == 2


def test_a_hot_key_and_hour_is_split(spark, monkeypatch):
    """Nine of ten rows in one key and hour: runs of failures go on across many small partitions."""
    monkeypatch.setattr(ordering, "_PART_ROWS", 300)
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        hot = rng.random() < 0.9
        moment = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(3600) if hot else rng.randrange(10**6))
        rows.append((i, 1 if hot else rng.randrange(2, 9), moment, rng.random() < 0.995))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, bad boolean")
    assert ordering.ordered_slots(df, ["user_id", "ts", "event_id"]).select("_part").distinct().count() >= 15
    want, state = {}, {}
    for event, user, _, bad in sorted(rows, key=lambda r: (r[2], r[0])):
        state[user] = state.get(user, 0) + 1 if bad else 0
        want[event] = state[user]
    got = {r["event_id"]: r["run"] for r in sequences.failure_runs(df, "user_id", "ts", "event_id", F.col("bad")).collect()}
    assert got == want and max(want.values()) > 600
    found = {(r["user_id"], r["session_start"], r["session_end"], r["events"]) for r in sequences.sessions(df, "user_id", "ts").collect()}
    assert found == plain_sessions(df, 7200)


@pytest.mark.parametrize("parts", [1, 7])
def test_pairs_of_a_hot_key_are_cut_by_rows(spark, monkeypatch, parts):
    """Nine of ten marks are one key's; partitions end between an opening event and its closing one."""
    rng = random.Random(6)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(800):
        start += dt.timedelta(seconds=rng.choice([0, 5, 900]))
        rows.append((1 if rng.random() < 0.9 else rng.choice([None, 2, 3]), start, i, rng.choice(["in", "out", "other", None])))
    now = dt.datetime(2025, 1, 1)
    want = []
    for key in {r[0] for r in rows}:
        marks = sorted((r for r in rows if r[0] == key and r[3] in ("in", "out")), key=lambda r: r[1:3])
        for mark, after in zip(marks, [*marks[1:], None]):
            if mark[3] == "in":
                kind = "active" if after is None else "lost" if after[3] == "in" else "completed"
                end = {"active": now, "lost": None, "completed": after and after[1]}[kind]
                want.append((key or 0, kind, mark[1], end if kind == "completed" else None, None if end is None else int((end - mark[1]).total_seconds())))
    monkeypatch.setattr(ordering, "_partitions", lambda spark, rows: parts)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "who long, at timestamp_ntz, id long, what string").repartition(5)
    found = sequences.paired_sessions(df, "who", "at", "id", F.col("what") == "in", F.col("what") == "out", F.lit(now))
    got = [(r.who or 0, r.status, r.at if "at" in found.columns else r.ts, r.ended, r.duration_seconds) for r in found.collect()]
    key = lambda r: (r[0], r[2], r[1], str(r[3]), str(r[4]))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("days", [1, 3, 40])
def test_written_split_marks_the_same_rows(spark, days):
    """Rows with and without a date, equal rows and null ties; ties are kept for the day of the cut alone."""
    rng = random.Random(days)
    rows = [(None if days > 1 and rng.random() < 0.1 else dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(days), hours=rng.randrange(3)),
             rng.choice([None, 1, 2, 3]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, tie int, id int")
    split = ordering.split_written(df, "at", ["tie"], ["id"])
    late = lambda frame, c: {r["id"] for r in frame.where(c).select("id").collect()}
    assert late(split, "second") == late(df, ordering.split_after(df, "at", ["tie"])) and split.columns == ["id", "second"]
    assert ordering.split_written(df.limit(0), "at", ["tie"], ["id"]).count() == 0
