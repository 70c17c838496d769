"""Whole-table order without a one-task window.

Rows are range partitioned and sorted once, written to the shared scratch folder together with their slot
(partition number and place inside it), and read back. The written copy is what keeps the numbering the same
for every later use, also when executors are lost. Global positions are the place plus the sizes of the earlier
partitions. That size table has one row per partition of a few million rows, which is why it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabularium.session import delete, scratch_path, written

_PLACE_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit
_PART_ROWS, _SMALL_PART_ROWS = 4_000_000, 50_000


def _partitions(spark, rows: int) -> int:
    """Range partitions of a few million rows; enough of them to use a small cluster's cores on small tables."""
    return max(-(-rows // _PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // _SMALL_PART_ROWS)), 1)


def ordered_slots(df: DataFrame, keys: list, unique: bool = False) -> DataFrame:
    """``df`` sorted by ``keys`` with ``_part`` and ``_place`` columns, written and read back.

    The input is written first: sampling the range bounds and shuffling would otherwise compute it twice, and its
    row count (from the file footers) sets the number of partitions. Range partitions cannot split rows with equal
    keys, and copies of one row may be many; unless the keys are unique, the rows are numbered in that first copy (a
    re-run task reads the same numbers) and the number is the last sort key.
    """
    spark = df.sparkSession
    staged = scratch_path(spark, "staged")
    (df if unique else df.withColumn("_tie", F.monotonically_increasing_id())).write.parquet(staged)
    df = spark.read.parquet(staged)
    keys = keys if unique else [*keys, "_tie"]
    path = scratch_path(spark, "ordered")
    (df.repartitionByRange(_partitions(spark, df.count()), *keys).sortWithinPartitions(*keys).drop("_tie")
       .withColumn("_slot", F.monotonically_increasing_id())
       .write.parquet(path))
    delete(spark, staged)
    back = spark.read.schema(df.drop("_tie").schema.add("_slot", "long")).parquet(path)
    return (back.withColumn("_part", F.shiftright("_slot", _PLACE_BITS))
                .withColumn("_place", F.col("_slot").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
                .drop("_slot"))


def with_position(df: DataFrame, keys: list, name: str = "position", unique: bool = False) -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys`` (make the keys total)."""
    slots = ordered_slots(df, keys, unique)
    sizes = slots.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    return (slots.join(F.broadcast(starts), "_part")
                 .withColumn(name, (F.col("_start") + F.col("_place")).cast("bigint"))
                 .drop("_part", "_place", "_start"))


def every_nth(df: DataFrame, keys: list, points: int = 100) -> DataFrame:
    """Rows at positions 0, step, 2*step … with step = max(1, rows // points)."""
    placed = with_position(df, keys)
    step = placed.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / F.lit(points)))).scalar()
    return placed.filter(F.col("position") % step == 0).withColumn("step", step)


def fill_along(df: DataFrame, column: str, keys: list, forward: bool = True, name: str | None = None) -> DataFrame:
    """Replace nulls by the previous (or next) non-null value in the order of ``keys``.

    Each range partition fills itself; the value carried across a partition edge comes from a summary with one
    row per partition.
    """
    name = name or column
    slots = ordered_slots(df, keys)
    order = W.partitionBy("_part").orderBy("_place" if forward else F.desc("_place"))
    inside = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = slots.withColumn("_inside", F.last(column, ignorenulls=True).over(inside))
    pick = F.max_by if forward else F.min_by
    edges = slots.groupBy("_part").agg(
        pick(F.col(column), F.when(F.col(column).isNotNull(), F.col("_place"))).alias("_edge"))
    across = W.orderBy("_part" if forward else F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    carried = edges.select("_part", F.last("_edge", ignorenulls=True).over(across).alias("_carried"))
    return (filled.join(F.broadcast(carried), "_part")
                  .withColumn(name, F.coalesce("_inside", "_carried"))
                  .drop("_part", "_place", "_inside", "_carried"))


def with_next(df: DataFrame, keys: list, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Add the values that ``columns`` have in the next row in the order of ``keys``, null in the last row.

    Inside a partition the next row is at hand; the first row of the next partition comes from a summary with one row per
    partition. No group of equal keys is ever one task's.
    """
    slots = ordered_slots(df, keys)
    inside = W.partitionBy("_part").orderBy("_place")
    row = F.struct(*columns)
    firsts = slots.groupBy("_part").agg(F.min_by(row, "_place").alias("_first"))
    following = firsts.select("_part", F.lead("_first").over(W.orderBy("_part")).alias("_following"))
    told = (slots.withColumn("_next", F.lead(row).over(inside)).join(F.broadcast(following), "_part")
                 .withColumn("_next", F.coalesce("_next", "_following")))
    return told.withColumns({prefix + c: F.col("_next")[c] for c in columns}).drop("_part", "_place", "_next", "_following")


def _cut_day(df: DataFrame, moment: str, fraction_of: int):
    """The day that holds position ``rows // fraction_of`` in the order of ``moment`` with that position inside it, or None."""
    per_day = df.groupBy(F.to_date(moment).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    running = W.orderBy("d")
    cut = (per_day
           .select("d", "n", F.sum("n").over(running).alias("upto"),
                   F.floor(F.sum("n").over(W.partitionBy()) / F.lit(fraction_of)).alias("at"))
           .filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
           .first())
    return None if cut is None else (cut["d"], int(cut["at"] - (cut["upto"] - cut["n"])))


def _from_edge(on_day: DataFrame, keys: list[str], inside: int, here: Column) -> Column:
    """True for the rows of the cut day from its row ``inside`` on; ``here`` is their keys as a struct."""
    edge = with_position(on_day, keys).filter(F.col("position") == inside).first()
    return here >= F.struct(*[F.lit(edge[k]).cast(on_day.schema[k].dataType).alias(k) for k in keys])


def split_after(df: DataFrame, moment: str, ties: list[str], fraction_of: int = 2) -> Column:
    """Predicate that is true for the rows from position ``rows // fraction_of`` on, ordered by moment and ties.

    Only the day that holds the cut is ranked; every other row is decided by its day alone.
    """
    cut = _cut_day(df, moment, fraction_of)
    if cut is None:
        return F.lit(False)
    day, (d, inside), keys = F.to_date(moment), cut, [moment, *ties]
    on_day = F.lit(d)
    if inside == 0:
        return day >= on_day
    late = _from_edge(df.filter(day == on_day).select(*keys), keys, inside, F.struct(*[F.col(k) for k in keys]))
    return (day > on_day) | ((day == on_day) & late)


def split_written(df: DataFrame, moment: str, ties: list[str], columns: list[str], fraction_of: int = 2, name: str = "second") -> DataFrame:
    """``columns`` of ``df`` and the predicate of :func:`split_after` as ``name``, written once.

    For a ``df`` that is much work: after the count per day it is made once more, and the moment and ties are kept for the rows
    of the day that holds the cut alone.
    """
    cut = _cut_day(df, moment, fraction_of)
    if cut is None:
        return df.select(*columns, F.lit(False).alias(name))
    day, (d, inside), keys = F.to_date(moment), cut, [moment, *ties]
    on_day = F.lit(d)
    if inside == 0:
        return written(df.select(*columns, (day >= on_day).alias(name)), "split")
    tie = F.when(day == on_day, F.struct(*[F.col(k) for k in keys]))
    kept = written(df.select(*columns, (day > on_day).alias("_after"), tie.alias("_tie")), "split")
    late = _from_edge(kept.where("_tie IS NOT NULL").select("_tie.*"), keys, inside, F.struct(*[F.col("_tie")[k].alias(k) for k in keys]))
    return kept.select(*columns, F.when(F.col("_tie").isNotNull(), late).otherwise(F.col("_after")).alias(name))


def page(df: DataFrame, keys: list, number: int, size: int | None, shallow: int = 100_000) -> DataFrame:
    """Rows of one page in a stable order; ``size`` None or <= 0 means every row.

    A shallow page is a top-k. A deep one would make every task keep offset + size rows, so it is cut out of
    the distributed order instead.
    """
    if size is None or size <= 0:
        return df.orderBy(*keys)
    skip = (max(1, number) - 1) * size
    if skip + size <= shallow:
        return df.orderBy(*keys).offset(skip).limit(size)
    placed = with_position(df, keys)
    return placed.filter(F.col("position").between(skip, skip + size - 1)).orderBy("position").drop("position")


def with_running_sum(df: DataFrame, keys: list, weight: str, name: str = "upto") -> DataFrame:
    """Add the sum of ``weight`` over this row and all earlier ones in the order of ``keys``, which must be unique."""
    slots = ordered_slots(df, keys, unique=True)
    sums = slots.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (slots.withColumn("_inside", F.sum(weight).over(inside)).join(F.broadcast(starts), "_part")
                 .withColumn(name, F.col("_start") + F.col("_inside"))
                 .drop("_part", "_place", "_inside", "_start"))
