"""Hard negatives by slot-decomposed selection.

1. Rows are prepared once (labels, integer components) and written. Anchors and rows meet in tiles: a group of at most
   ``GROUP`` anchors and a part of the rows. A tile's anchors come first and its rows stream past them in Arrow batches, so a
   task holds the group and one batch, however many rows there are and whatever labels, copies or ids are frequent.
2. First pass: each tile keeps the best ``positives`` other rows of the anchor's label, the combiner of the top-k after it.
3. Second pass: a positive with score p takes negatives with scores in [low * p, high * p]. The windows overlap, but their upper
   limits, in falling order, cut the scores into disjoint slots: slot i holds the scores up to limit i and above limit i + 1.
   Each tile keeps the best ``negatives`` rows of every slot. The rows up to limit i are slots i, i + 1, … one after another, so
   one merge of the slots in falling order answers all windows: window i is the first ``negatives`` from slot i on, cut at its
   lower limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.llm.store import drop, kept, partitions

#: Anchors of a tile: 4096 vectors of 64 doubles are 2 MB.
GROUP = 4096
#: Rows of a tile, about; fewer where the cluster has more partitions than that gives.
PART = 1 << 18
#: Scores computed at once.
CELLS = 1 << 21
LONGEST = 2 ** 63 - 1
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0 ** 53


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors as 64-bit integers; beyond these, the largest or smallest one."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if np.abs(anchors).max() * np.abs(rows).max() * anchors.shape[1] < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = [[[int(v) for v in x] for x in m] for m in (anchors, rows)]
    out = [[max(-LONGEST - 1, min(LONGEST, sum(p * q for p, q in zip(a, b)))) for b in whole[1]] for a in whole[0]]
    return np.array(out, np.int64)


class Best:
    """For each anchor of a tile and each of its slots the first k rows by falling score, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, ids]
        by = np.lexsort((ids, -1 - score, slot))  # -1 - x falls with x and never overflows
        slot, score, ids = slot[by], score[by], ids[by]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        stay = place < self.k
        self.slot, self.score, self.id = slot[stay], score[stay], ids[stay]

    def floors(self) -> np.ndarray:
        """The score below which a row cannot enter a slot any more."""
        out = np.full(self.slots, -LONGEST - 1)
        count = np.bincount(self.slot, minlength=self.slots)
        full = count >= self.k
        out[full] = self.score[np.cumsum(count)[full] - 1]
        return out


def tile_rows(k: int, negative: bool, width: int):
    """Runs of one tile arrive as its anchors and then its rows; emits each anchor's best rows by slot.

    Anchors carry ``limits``: falling upper limits, and last the lowest score wanted. Without them all is one slot.
    """
    def select(batches):
        mark, anchor, best = None, None, None

        def done():
            if best is None or not len(best.slot):
                return
            at, slot = np.divmod(best.slot, width)
            yield pa.RecordBatch.from_arrays([pa.array(anchor["key"][at]), pa.array(slot.astype(np.int32)), pa.array(best.id), pa.array(best.score)],
                                             names=["key", "slot", "vec_id", "score"])

        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "dim", "kind", "key", "vec_id", "label")}
            change = (cols["tile"][1:] != cols["tile"][:-1]) | (cols["dim"][1:] != cols["dim"][:-1]) | (cols["kind"][1:] != cols["kind"][:-1])
            cuts = np.r_[0, np.flatnonzero(change) + 1, batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                now = (cols["tile"][a], cols["dim"][a])
                if now != mark:
                    yield from done()
                    mark, anchor, best = now, {"key": np.zeros(0, np.int64)}, None
                if cols["kind"][a] == 0:
                    part = batch.slice(a, b - a)
                    new = {c: cols[c][a:b] for c in ("key", "vec_id", "label")} | {"x": matrix(part.column("vector"))}
                    if negative:
                        new["limits"] = np.array(part.column("limits").to_pylist(), np.int64).reshape(b - a, width + 1)
                    anchor = new if not len(anchor["key"]) else {c: np.concatenate([anchor[c], new[c]]) for c in new}
                    continue
                if not len(anchor["key"]):
                    continue
                best = best or Best(len(anchor["key"]) * width, k)
                step = max(1, CELLS // len(anchor["key"]))
                for at in range(a, b, step):
                    to = min(b, at + step)
                    score = products(anchor["x"], matrix(batch.column("vector").slice(at, to - at)))
                    same = anchor["label"][:, None] == cols["label"][None, at:to]
                    floors = best.floors().reshape(-1, width)
                    if negative:
                        wanted = ~same & (score <= anchor["limits"][:, :1]) & (score >= anchor["limits"][:, -1:])
                        who, row = np.nonzero(wanted)
                        score = score[who, row]
                        slot = (score[:, None] <= anchor["limits"][who, 1:-1]).sum(axis=1)
                        live = score >= floors[who, slot]
                        who, row, score, slot = who[live], row[live], score[live], slot[live]
                    else:
                        who, row = np.nonzero(same & (anchor["vec_id"][:, None] != cols["vec_id"][None, at:to]) & (score >= floors))
                        score, slot = score[who, row], 0
                    best.add(who * width + slot, score, cols["vec_id"][at:to][row])
        yield from done()
    return select


def tiles(rows: DataFrame, anchors: DataFrame, groups: int, parts: int) -> DataFrame:
    """Rows of all tiles: each anchor in its group's tiles, each row in the tiles of its part, anchors first."""
    where = (F.col("group") * parts + F.col("part")).cast("long").alias("tile")
    columns = ["key", "vec_id", "label", "vector"]
    left = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        where, F.size("vector").alias("dim"), F.lit(0).alias("kind"), *columns, "limits")
    right = rows.withColumn("part", F.pmod("key", F.lit(parts))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        where, F.size("vector").alias("dim"), F.lit(1).alias("kind"), *columns, F.lit(None).cast("array<long>").alias("limits"))
    return left.unionByName(right).repartition(groups * parts, "tile").sortWithinPartitions("tile", "dim", "kind")


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, relabel_every: int = 7, labels: int = 10, positives: int = 5,
                   negatives: int = 10, low_pct: int = 30, high_pct: int = 90, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the columns vec_id, embedding and label.

    Rows without vec_id or label, with a null vector or with null or non-finite components take no part. Other columns are not
    read. Exact repeats of a row (id, label and vector) are one row; rows that share an id but differ are rows of their own, and
    an anchor's "other rows" are those of other ids. Vectors meet only vectors of their own length. Ties go to the smaller vec_id.
    Scores are exact whole numbers; beyond 64 bits they stop at the largest or smallest one. No rows give no rows.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
                      & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    # (x * scale) would overflow for the largest doubles; those are whole numbers already
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < 1e300, _floor(x * scale)).otherwise(x))
    rows = kept(rows.dropDuplicates().select("vec_id", label.alias("label"), whole.alias("vector"))
                .withColumn("key", F.monotonically_increasing_id()), "vectors")
    chosen = rows.where(F.col("vec_id") % anchor_every == 0)
    n, asked = rows.count(), chosen.count()
    groups = max(1, -(-asked // GROUP))
    parts = max(1, min(partitions(spark), -(-n // 2048)), -(-n // PART))
    chosen = kept(chosen.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")), "anchors")
    empty = chosen.withColumn("limits", F.lit(None).cast("array<long>"))
    found = "key long, slot int, vec_id long, score long"
    order = [F.desc("score"), "vec_id"]
    near = tiles(rows, empty, groups, parts).mapInArrow(tile_rows(positives, False, 1), found)
    place = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    near = kept(near.withColumn("place", place).where(F.col("place") <= positives).select("key", "place", "vec_id", "score"), "positives")
    # upper limits floor(high * p) in the order of the positives, padded to a fixed number; last the lowest score of any window
    high = F.floor((F.col("score").cast("decimal(30,0)") * high_pct) / 100)
    low = F.ceil((F.col("score").cast("decimal(30,0)") * low_pct) / 100)
    windows = near.where("score >= 0").withColumns({"high": high.cast("long"), "low": low.cast("long")})
    limits = windows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "high", "low"))).alias("w"))
    limits = limits.select("key", F.concat(F.transform("w", lambda x: x["high"]), F.array_repeat(F.lit(-LONGEST - 1), positives - F.size("w")),
                                           F.array(F.array_min(F.transform("w", lambda x: x["low"])))).alias("limits"))
    second = chosen.join(limits, "key")
    far = tiles(rows, second, groups, parts).mapInArrow(tile_rows(negatives, True, positives), found)
    place = F.row_number().over(Window.partitionBy("key", "slot").orderBy(*order))
    far = far.withColumn("n", place).where(F.col("n") <= negatives)
    # at most positives * negatives rows an anchor, slots in falling order of their scores
    merged = far.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", "n", "vec_id", "score"))).alias("slots"))
    window = F.filter(F.slice(F.filter("slots", lambda x: x["slot"] >= F.col("place") - 1), 1, negatives), lambda x: x["score"] >= F.col("low"))
    out = (windows.join(merged, "key").join(chosen.select("key", F.col("vec_id").alias("anchor_id")), "key")
           .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(window).alias("n", "row"))
           .select("anchor_id", "positive_id", (F.col("n") + 1).alias("rank"), F.col("row.vec_id").alias("negative_id"),
                   "positive_score", F.col("row.score").alias("negative_score")))
    out = kept(out, "negatives")
    drop(rows, chosen, near)
    return out


def _floor(x):
    """floor() of a double as a double, for any size: above 2**52 all doubles are whole."""
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)
