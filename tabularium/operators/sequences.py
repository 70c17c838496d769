"""Per-key event sequences that stay balanced when one key holds a large share of all rows.

Sessions need no window over rows: events of one key in one slot as wide as the idle time always belong together, so a
partial aggregate per (key, slot) comes first and the per-key windows see a row per slot. Runs of failures and pairs of
opening and closing events are found in one distributed order of all rows, cut by rows and not by keys; a summary with one
row per partition carries the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabularium.functions.dates import seconds_between
from tabularium.operators import ordering


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def session_runs(df: DataFrame, key: str, moment: str, idle_seconds: int = 7200) -> DataFrame:
    """``(key, slot, first, last, n)``: the events of each key in each time slot as wide as the idle time, which cannot be
    apart by that much. Runs of parts of the rows can be put together again by :func:`joined_runs`."""
    slot = F.floor(_micros(moment) / F.lit(idle_seconds * 1_000_000)).cast("bigint")
    return df.filter(F.col(moment).isNotNull()).groupBy(key, slot.alias("slot")).agg(
        F.min(moment).alias("first"), F.max(moment).alias("last"), F.count(F.lit(1)).alias("n"))


def joined_runs(runs: DataFrame, key: str, idle_seconds: int = 7200) -> DataFrame:
    """``(key, session_start, session_end, events)`` from runs; a gap of at least ``idle_seconds`` starts a new session."""
    whole = runs.groupBy(key, "slot").agg(F.min("first").alias("_from"), F.max("last").alias("_to"), F.sum("n").alias("_n"))
    per_key = W.partitionBy(key).orderBy("slot")
    apart = _micros("_from") - F.lag(_micros("_to")).over(per_key)
    flagged = whole.withColumn("_new", F.when(apart < idle_seconds * 1_000_000, 0).otherwise(1))
    numbered = flagged.withColumn("_session", F.sum("_new").over(per_key.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(key, "_session").agg(
        F.min("_from").alias("session_start"), F.max("_to").alias("session_end"), F.sum("_n").alias("events")).drop("_session")


def sessions(df: DataFrame, key: str, moment: str, idle_seconds: int = 7200) -> DataFrame:
    """``(key, session_start, session_end, events)``: a gap of at least ``idle_seconds`` starts a new session."""
    return joined_runs(session_runs(df, key, moment, idle_seconds), key, idle_seconds)


def paired_sessions(df: DataFrame, key: str, moment: str, tie: str, opens: Column, closes: Column, now: Column) -> DataFrame:
    """``(key, status, ts, ended, duration_seconds)``: each opening event with the first closing event of its key before the
    next opening; without one the session is still open if it is the key's last, and lasts until ``now``, else it was lost.

    The marks of all keys are one distributed order, cut by rows, so that a key may hold any share of them.
    """
    marks = df.filter(opens | closes).select(key, moment, tie, F.coalesce(opens, F.lit(False)).alias("_open"))
    # the next mark decides: a closing one ends the session, an opening one means that it was lost
    told = ordering.with_next(marks, [key, moment, tie], [key, moment, "_open"], "_next_").filter("_open")
    same = F.col(key).eqNullSafe(F.col("_next_" + key)) & F.col("_next__open").isNotNull()
    paired = told.withColumn("_next_open", F.when(same, F.col("_next__open"))).withColumn("_next", F.when(same, F.col("_next_" + moment)))
    status = F.when(F.col("_next_open").isNull(), "active").when(F.col("_next_open"), "lost").otherwise("completed")
    ended = F.when(status == "completed", F.col("_next"))
    length = F.when(status == "active", seconds_between(moment, now)).when(status == "completed", seconds_between(moment, F.col("_next")))
    return paired.select(key, status.alias("status"), F.col(moment).alias("ts"), ended.alias("ended"), length.alias("duration_seconds"))


def session_rows(found: DataFrame, key: str, now: Column, idle_seconds: int = 7200) -> DataFrame:
    """Log rows of sessions: active while ``now`` is less than the idle time after the last event."""
    quiet = seconds_between("session_end", now)
    active = quiet < idle_seconds
    return found.select(
        key, F.lit("SESSION").alias("event_type"),
        F.when(active, "active").otherwise("completed").alias("status"),
        F.col("session_start").alias("ts"),
        F.when(active, seconds_between("session_start", now)).otherwise(
            seconds_between("session_start", F.col("session_end"))).alias("duration_seconds"))


def failure_runs(df: DataFrame, key: str, moment: str, tie: str, failed: Column) -> DataFrame:
    """Add ``run``: failures in a row up to this row (0 after a success), ordered by moment and tie."""
    slots = ordering.ordered_slots(df.withColumn("_fail", F.coalesce(failed, F.lit(False))), [key, moment, tie])
    order = W.partitionBy("_part").orderBy("_place")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    turned = ~F.col(key).eqNullSafe(F.lag(key).over(order)) & (F.col("_place") > 0)
    # a block ends at a success (which lies in the block that it begins) or where the key changes
    blocks = (slots.withColumn("_ends", F.when(~F.col("_fail") | turned, 1).otherwise(0))
                   .withColumn("_block", F.sum("_ends").over(upto))
                   .withColumn("_inside", F.sum(F.col("_fail").cast("long")).over(
                       W.partitionBy("_part", "_block").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow))))
    per_part = blocks.groupBy("_part").agg(
        F.min_by(key, "_place").alias("_first"), F.max_by(key, "_place").alias("_last"), F.max_by("_inside", "_place").alias("_trailing"),
        (F.max("_block") == 0).alias("_whole"))
    by_part = W.orderBy("_part")  # one row per partition
    joins = F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(by_part)), F.lit(False))
    chains = (per_part.withColumn("_joins", joins)
              .withColumn("_chain", F.sum(F.when(F.col("_joins") & F.col("_whole"), 0).otherwise(1)).over(by_part.rowsBetween(W.unboundedPreceding, W.currentRow))))
    # what a partition hands on: its own trailing run, plus those before it while partitions are wholly one key's failures
    at_end = chains.withColumn("_at_end", F.sum("_trailing").over(
        W.partitionBy("_chain").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)))
    carried = at_end.select("_part", F.when(F.col("_joins"), F.coalesce(F.lag("_at_end").over(by_part), F.lit(0))).otherwise(F.lit(0)).alias("_carried"))
    run = F.col("_inside") + F.when(F.col("_block") == 0, F.col("_carried")).otherwise(F.lit(0))
    return blocks.join(F.broadcast(carried), "_part").withColumn("run", F.when(F.col("_fail"), run).otherwise(F.lit(0)).cast("bigint")).drop(
        "_part", "_place", "_fail", "_ends", "_block", "_inside", "_carried")


def last_rows(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The last n rows per key; the row limit is applied before the shuffle as well."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_r", place).filter(F.col("_r") <= n).drop("_r")


def busy_windows(df: DataFrame, key: str, moment: str, width: str, at_least: int) -> DataFrame:
    """``(key, window_start, hits)``: fixed windows in which a key reaches the limit."""
    counted = df.groupBy(key, F.window(moment, width).alias("w")).agg(F.count(F.lit(1)).alias("hits"))
    return counted.filter(F.col("hits") >= at_least).select(key, F.col("w.start").alias("window_start"), "hits")


def daily_volume(df: DataFrame, moment: str, days: int = 7) -> DataFrame:
    """``(day, day_label, hits, normalized)`` for each of the last days, empty days as 0, largest day = 100."""
    if days < 1:
        raise ValueError("days must be at least 1")
    newest = df.agg(F.max(F.to_date(moment)).alias("d"))
    anchor = newest.scalar()
    counted = df.filter(F.to_date(moment) >= F.date_sub(anchor, days - 1)).groupBy(F.to_date(moment).alias("day")).agg(
        F.count(F.lit(1)).alias("hits"))
    slots = newest.select(F.explode(F.sequence(F.date_sub("d", days - 1), F.col("d"))).alias("day"))
    full = slots.join(counted, "day", "left").select("day", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))
    most = F.greatest(F.lit(1), F.max("hits").over(W.partitionBy()))  # one row per day asked for
    return full.select("day", F.date_format("day", "EEE").alias("day_label"), "hits",
                       F.floor(F.col("hits") * 100.0 / most + 0.5).cast("bigint").alias("normalized"))
