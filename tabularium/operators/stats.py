"""Column statistics: exact quantiles, modes, value frequencies, null and duplicate counts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabularium.operators import ordering
from tabularium.session import written

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Accuracy of the quantile sketch: its ranks are off by a twenty-thousandth of the rows at most.
ACCURACY = 20_000

# Columns per aggregate: one huge aggregate over a wide table outgrows what the JVM compiles. Batches read different
# columns, so every column is still read once.
COLUMNS_PER_PASS = 40


def in_batches(columns: list[str], size: int | None = None) -> list[list[str]]:
    size = size or COLUMNS_PER_PASS
    return [columns[i:i + size] for i in range(0, len(columns), size)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def _value(name: str) -> Column:
    """The column as a double, NaN read as null."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = ACCURACY, stage: bool = True) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, a few numbers per column, for every column at once, in two scans.

    ``df`` may be the result of much work, so its numbers are written first; without ``stage`` it is scanned itself.
    The first scan's sketch brackets each wanted rank: the approximate quantiles a little to its left and right hold it
    between them. The second counts the rows below each bracket and the values inside (a few ten-thousandths of the rows),
    among which the ranks are picked in order. Values may be infinite and spread over any range. NaN is null.
    """
    if not columns:
        return {}
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    numbers = df.select(*[_value(c).alias(name) for c, name in names.items()])
    found = _quantiles(written(numbers, "numbers") if stage else numbers, list(names.values()), probs, accuracy)
    return {c: found[name] for c, name in names.items()}


def _quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int) -> dict[str, list[float | None]]:
    sketched: dict[str, tuple] = {}
    slack = 4.0 / accuracy
    edges = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)} | {0.0, 1.0})
    for part in in_batches(columns):
        row = df.agg(*[f for c in part for f in (F.count(_value(c)), F.min(_value(c)), F.max(_value(c)),
                                                 F.percentile_approx(_value(c), F.array(*[F.lit(e) for e in edges]), accuracy))]).first()
        sketched |= {c: tuple(row[4 * i:4 * i + 4]) for i, c in enumerate(part)}
    out = {c: [None] * len(probs) for c in columns}
    brackets = []  # (column, place of the probability, lower and upper edge)
    for c in columns:
        n, least, most, at = sketched[c]
        for k, p in enumerate(probs if n else []):
            low, high = (at[edges.index(min(1.0, max(0.0, p + d)))] for d in (-slack, slack))
            brackets.append((c, k, least if p <= slack else low, most if p >= 1 - slack else high))
    ranks = lambda c, k: (math.floor((sketched[c][0] - 1) * probs[k]), math.ceil((sketched[c][0] - 1) * probs[k]))
    # a bracket of one value needs no look inside
    found = {(c, k): dict.fromkeys(ranks(c, k), lo) for c, k, lo, hi in brackets if lo == hi}
    for wide in (False, True):  # a sketch that misses its bound would be widened to the whole range; none has been seen to
        todo = [(c, k, *((sketched[c][1], sketched[c][2]) if wide else (lo, hi))) for c, k, lo, hi in brackets if (c, k) not in found]
        for part in in_batches(todo, COLUMNS_PER_PASS):
            found |= _pick_ranks(df, [(c, lo, hi, ranks(c, k)) for c, k, lo, hi in part], [(c, k) for c, k, _, _ in part])
    for c, k, _, _ in brackets:
        at = (sketched[c][0] - 1) * probs[k]
        a, b, w = found[c, k][math.floor(at)], found[c, k][math.ceil(at)], at - math.floor(at)
        finite = math.isfinite(a) and math.isfinite(b)
        out[c][k] = a if a == b or not w else a + (b - a) * w if finite else a * (1 - w) + b * w
    return out


def _pick_ranks(df: DataFrame, brackets: list[tuple], names: list[tuple]) -> dict:
    """The values at the wanted ranks of each bracket (column, lower, upper, ranks), for brackets that hold them all."""
    names_of = list(dict.fromkeys(c for c, *_ in brackets))

    def look(batches):
        """Values inside each bracket with their counts, and last what lies below it, as a null value."""
        under = np.zeros(len(brackets), np.int64)
        give = lambda b, v, n: pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(v, pa.float64()), pa.array(n, pa.int64())], names=["b", "v", "n"])
        for batch in batches:
            column = {c: batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(names_of)}
            for i, (c, lo, hi, _) in enumerate(brackets):
                x = column[c]
                under[i] += np.count_nonzero(x < lo)
                v, n = np.unique(x[(x >= lo) & (x <= hi)], return_counts=True)
                if len(v):
                    yield give(np.full(len(v), i), v, n)
        yield give(np.arange(len(brackets)), [None] * len(brackets), under)

    values = df.select(*[_value(c).alias(f"c{i}") for i, c in enumerate(names_of)])
    held = written(values.mapInArrow(look, "b int, v double, n long").groupBy("b", "v").agg(F.sum("n").alias("n")), "brackets")
    below = {r["b"]: r["n"] for r in held.where("v IS NULL").collect()}  # one row per bracket
    upto = W.partitionBy("b").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = held.where("v IS NOT NULL").withColumn("to", F.sum("n").over(upto))
    base = F.element_at(F.array(*[F.lit(below.get(i, 0)).cast("long") for i in range(len(brackets))]), F.col("b") + 1)
    spans = spans.withColumn("to", base + F.col("to")).withColumn("from", F.col("to") - F.col("n"))
    wanted = F.element_at(F.array(*[F.array(*[F.lit(r).cast("long") for r in sorted(set(rs))]) for _, _, _, rs in brackets]), F.col("b") + 1)
    hits = spans.select("b", "v", F.explode(wanted).alias("rank"), "from", "to").filter("rank >= `from` AND rank < `to`").collect()
    got: dict = {}
    for r in hits:  # at most two rows per bracket
        got.setdefault(names[r["b"]], {})[r["rank"]] = r["v"]
    return {name: got[name] for name, (_, _, _, rs) in zip(names, brackets) if name in got and set(rs) <= set(got[name])}


def iqr_bounds(df: DataFrame, columns: list[str], **kw) -> dict[str, tuple[float, float]]:
    """Lower and upper outlier fence (1.5 times the interquartile range) per column; empty columns are left out."""
    out = {}
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75], **kw).items():
        if q1 is not None:
            out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value, n)`` for the non-null values of every column, from one shuffle of partial counts."""
    texts = df.select(*[_as_text(df, c).alias(c) for c in columns])
    return (texts.unpivot([], columns, "column_name", "value")
                 .filter(F.col("value").isNotNull())
                 .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def _as_text(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)
    return c.cast("string")


def nunique(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, nunique)``; a column without any value has no row.

    Columns are stacked by kind (whole, fraction, other), so numbers are compared as numbers and every column is
    still read once.
    """
    fractions = (T.FloatType, T.DoubleType)
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        whole = isinstance(kind, NUMERIC_TYPES) and not isinstance(kind, (*fractions, T.DecimalType))
        kinds.setdefault("bigint" if whole else "double" if isinstance(kind, fractions) else "string", []).append(c)
    out = None
    for kind, names in kinds.items():
        value = {"bigint": lambda c: F.col(f"`{c}`").cast("bigint"), "double": _value}.get(kind, lambda c: F.col(f"`{c}`").cast("string"))
        one = (df.select(*[value(c).alias(c) for c in names]).unpivot([], names, "column_name", "value")
                 .filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.lit(1))
                 .groupBy("column_name").agg(F.count(F.lit(1)).alias("nunique")))
        out = one if out is None else out.unionByName(one)
    return out


# Relative standard error of the distinct-count sketch (3 KB a column), and how many of them its interval goes to either side.
SKETCH_ERROR, SKETCH_WIDTH = 0.02, 6


def distinct_bounds(c: Column) -> tuple[Column, Column]:
    """Lower and upper bound of a column's distinct values, as aggregates of one mergeable sketch."""
    about = F.approx_count_distinct(c, SKETCH_ERROR)
    return (F.floor(about * (1 - SKETCH_WIDTH * SKETCH_ERROR)).cast("bigint"),
            F.least(F.count(c), F.ceil(about * (1 + SKETCH_WIDTH * SKETCH_ERROR)).cast("bigint") + 1))


# Distinct values up to which a column's values are all counted, and buckets that bound the counts of the others.
FEW_VALUES, BUCKETS, HEAVY = 100_000, 1 << 16, 4


def frequent_values(df: DataFrame, columns: list[str], n: int, few: int = FEW_VALUES, buckets: int = BUCKETS) -> DataFrame:
    """``(column_name, value, n, present, rank)``: each column's n most frequent non-null values as text, smaller ones first on ties.

    Columns of few values are counted whole. For the others, rows per hash bucket are counted first, which takes a fixed number of
    rows per task: no value stands more often than its bucket. The values of the heaviest buckets are counted exactly; their n-th
    count proves that nothing in a lighter bucket belongs to the result. Buckets for which it proves nothing are counted too: by
    fingerprints, and by value where a fingerprint is repeated often enough.
    """
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column_name string, value string, n long, present long, rank int")
    high = {}
    for part in in_batches(columns):
        row = df.agg(*[distinct_bounds(_as_text(df, c))[1] for c in part]).first()
        high |= dict(zip(part, row))
    small, large = [c for c in columns if high[c] <= few], [c for c in columns if high[c] > few]
    out = None
    if small:
        counts = value_counts(df, small)
        out = counts.join(counts.groupBy("column_name").agg(F.sum("n").alias("present")), "column_name")
    if large:
        found = _frequent_of_many(df, large, n, buckets)
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(W.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return out.withColumn("rank", place).where(F.col("rank") <= n).select("column_name", "value", "n", "present", "rank")


def _frequent_of_many(df: DataFrame, columns: list[str], n: int, buckets: int) -> DataFrame:
    """``(column_name, value, n, present)`` that hold each column's n most frequent values, for columns of many values."""
    texts = (df.select(*[_as_text(df, c).alias(c) for c in columns]).unpivot([], columns, "column_name", "value").where("value IS NOT NULL")
             .withColumn("bucket", F.pmod(F.xxhash64("column_name", "value"), F.lit(buckets)).cast("int")))
    sums = written(texts.groupBy("column_name", "bucket").agg(F.count(F.lit(1)).alias("rows")), "buckets")
    heaviest = F.row_number().over(W.partitionBy("column_name").orderBy(F.desc("rows"), "bucket"))
    ranked = written(sums.withColumn("place", heaviest), "buckets")
    key = ["column_name", "bucket"]
    heavy = ranked.where(F.col("place") <= HEAVY * n).select(*key)  # a few buckets per column
    counted = written(texts.join(F.broadcast(heavy), key).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    place = F.row_number().over(W.partitionBy("column_name").orderBy(F.desc("n")))
    floors = counted.withColumn("p", place).where(F.col("p") == n).select("column_name", F.col("n").alias("floor"))
    unproven = written(ranked.where(F.col("place") > HEAVY * n).join(floors, "column_name", "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
                       .where(F.col("rows") >= F.col("floor")).select(*key, "floor"), "unproven")
    present = sums.groupBy("column_name").agg(F.sum("rows").alias("present"))
    if unproven.isEmpty():
        return counted.join(present, "column_name")
    marked = texts.join(unproven, key).select("column_name", "value", "floor", F.xxhash64("value").alias("f1"), F.xxhash64(F.lit(1), "value").alias("f2"))
    prints = ["column_name", "f1", "f2"]
    again = written(marked.groupBy(*prints, "floor").agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") >= F.col("floor")) & (F.col("rows") > 1)).select(*prints), "repeated")
    more = marked.join(again, prints, "left_semi").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    # where single values count, the smallest of them do
    smallest = F.row_number().over(W.partitionBy("column_name").orderBy("value"))
    single = (marked.where(F.col("floor") <= 1).join(again, prints, "left_anti").withColumn("p", smallest).where(F.col("p") <= n)
              .select("column_name", "value", F.lit(1).cast("long").alias("n")))
    return counted.unionByName(more).unionByName(single).join(present, "column_name")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, mode, n)``: most frequent value as text, the smallest one on ties."""
    return frequent_values(df, columns, 1).select("column_name", F.col("value").alias("mode"), "n")


def mode_of(df: DataFrame, column: str) -> Column:
    """Most frequent non-null value (smallest on ties) as a scalar, typed like the column."""
    c = F.col(f"`{column}`")
    return (df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc("v")).limit(1).select("v").scalar())


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, position, total_rows, null_count)``, one row per column."""
    return per_column(df, columns or df.columns, {
        "total_rows": lambda c: F.count(F.lit(1)), "null_count": lambda c: F.count_if(F.col(f"`{c}`").isNull())})


def per_column(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """One aggregate per batch of columns, one output row per column.

    ``measures`` maps an output name to ``fn(column name) -> aggregate Column``.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], ", ".join(
            ["column_name string", "position int", *[f"`{name}` double" for name in measures]]))
    out = None
    for part in in_batches(columns):
        one = df.agg(*[fn(c).alias(f"{name}__{i}") for i, c in enumerate(part) for name, fn in measures.items()])
        rows = [F.struct(F.lit(c).alias("column_name"), F.lit(columns.index(c) + 1).alias("position"),
                         *[F.col(f"{name}__{i}").alias(name) for name in measures])
                for i, c in enumerate(part)]
        stacked = one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
        out = stacked if out is None else out.unionAll(stacked)
    return out


def fingerprint(columns: list[str]) -> list[Column]:
    """64 bits that equal rows share, as a column; hashes skip nulls, so where they are is hashed as well."""
    cols = [F.col(f"`{c}`") for c in columns]
    nulls = [F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])] if cols else [F.lit(1)]
    return [F.xxhash64(*nulls, *cols).alias("_f1")]


# Bits of the filter of repeated fingerprints for each of them, and of the largest filter (8 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 26


def _marked(df: DataFrame) -> DataFrame:
    """``df`` under plain column names with its rows' fingerprints."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select("*", fingerprint([f.name for f in plain.schema.fields if not _has_map(f.dataType)])[0])


def _may_repeat(marked: DataFrame) -> Column | None:
    """False only for rows whose fingerprint no other row has; None if there are no other rows.

    Fingerprints alone are shuffled. The repeated ones become a bitmap of bounded size, which is tested where the rows are:
    the more of them there are, the more other rows pass. What passes has to be compared as whole rows.
    """
    repeated = written(marked.groupBy("_f1").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_f1"), "repeated")
    n = repeated.count()
    if not n:
        return None
    bits = min(MOST_BITS, 1 << max(10, (FILTER_BITS * n).bit_length()))
    place = F.pmod("_f1", F.lit(bits).cast("long"))
    one = F.expr("shiftleft(1L, CAST(pmod(_bit, 64) AS INT))")
    words = repeated.select(place.alias("_bit")).groupBy(F.expr("_bit div 64").alias("word")).agg(F.bit_or(one).alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy()

    def test(bit: pa.Array) -> pa.Array:
        at = bit.to_numpy()
        return pa.array((table[at >> 6] >> (at & 63) & 1).astype(bool), pa.bool_())

    return F.arrow_udf(test, "boolean")(place)


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` without repeats of whole rows, by fingerprints: rows that stand once stay where they are, only the others are
    shuffled. ``df`` is read three times, so it should be written.
    """
    marked = _marked(df)
    repeats = _may_repeat(marked)
    if repeats is None:
        return df
    once, others = (marked.where(which).drop("_f1") for which in (~repeats, repeats))
    return once.unionByName(others.distinct()).toDF(*df.columns)


def duplicate_count(df: DataFrame) -> Column:
    """Rows that repeat an earlier identical row, as a scalar.

    Eight bytes of each row are counted first. Whole rows are grouped only where a fingerprint may be repeated, so a table
    without repeats never shuffles its columns; different rows of one fingerprint are told apart there.
    """
    marked = _marked(df)
    repeats = _may_repeat(marked)
    if repeats is None:
        return F.lit(0).cast("bigint")
    copies = marked.where(repeats).groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint")).scalar()


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def group_quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float]) -> DataFrame:
    """``(key, one column per name in probs)``: exact, linear interpolation, for groups of any size.

    Equal values of a group become one row with a count, the rows are put in one distributed order, and the rows
    around each wanted rank are picked by running count. No group is held in one aggregation buffer.
    """
    v = F.col(value).cast("double")
    counts = (df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(key, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    running = ordering.with_running_sum(counts, [key, "_v"], "_n", "_upto")
    spans = running.groupBy(key).agg(F.sum("_n").alias("_size"), F.min(F.col("_upto") - F.col("_n")).alias("_start"))
    first = F.col("_upto") - F.col("_n") - F.col("_start")
    holds = lambda rank: (rank >= first) & (rank < first + F.col("_n"))
    picked = []
    for name, prob in probs.items():
        at = (F.col("_size") - 1) * F.lit(float(prob))
        low = F.max(F.when(holds(F.floor(at)), F.col("_v")))
        high = F.max(F.when(holds(F.ceil(at)), F.col("_v")))
        picked.append((low + (high - low) * F.first(at - F.floor(at))).alias(name))
    return running.join(spans, key).groupBy(key).agg(*picked)


def outlier_cells(df: DataFrame, columns: list[str] | None = None, **kw) -> DataFrame:
    """``(column_name, position, lower_bound, upper_bound, outliers)`` per numeric column."""
    columns = columns or numeric_columns(df)
    bounds = iqr_bounds(df, columns, **kw)
    return per_column(df, [c for c in columns if c in bounds], {
        "lower_bound": lambda c: F.first(F.lit(bounds[c][0])),
        "upper_bound": lambda c: F.first(F.lit(bounds[c][1])),
        "outliers": lambda c: F.count_if((_value(c) < bounds[c][0]) | (_value(c) > bounds[c][1])),
    })


def beyond_fences(df: DataFrame, columns: list[str], **kw) -> dict[str, Column]:
    """Outlier test per column."""
    return {c: (_value(c) < low) | (_value(c) > high) for c, (low, high) in iqr_bounds(df, columns, **kw).items()}
