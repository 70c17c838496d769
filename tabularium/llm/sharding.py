"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; the law is near-equal bytes.

Equal texts are one key of the ring, so copies stay together. Keys are summed into cells: ``CELLS`` places on the ring times
size classes (powers of two), a number that does not grow with the data. Cells heavier than ``HEAVY`` of a shard's share, which
only huge keys or few of them make, are split by hashes of single texts and then, if one text alone is as heavy, by hashes of its rows.
Each cell, heaviest first, goes to the first virtual node clockwise from its place whose shard still has room under
(1 + ``SLACK``) times the mean; cells that find a shard full continue clockwise. So no shard exceeds the bound by more than
one cell, and little moves when the load or the number of shards changes. Only cell sums reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm import words
from tabularium.llm.store import drop, kept

SHARDS, NODES, SLACK = 16, 256, 0.0002
CELLS, FINE, HEAVY = 2048, 64, 1 / 16
SLOTS = 4096


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all virtual nodes in ascending order, and whose they are. A shard's places do not depend on the others."""
    ids = np.arange(shards, dtype=np.uint64)[:, None] << np.uint64(32) | np.arange(nodes, dtype=np.uint64)
    places = words.mix(words.mix(ids.ravel()))
    order = np.argsort(places, kind="stable")
    return places[order], np.repeat(np.arange(shards), nodes)[order]


def assign(places: np.ndarray, sizes: np.ndarray, shards: int, nodes: int, slack: float) -> np.ndarray:
    """The shard of each cell: clockwise from its place, the first that still has room; if none has, the emptiest."""
    at, owner = ring(shards, nodes)
    start = np.searchsorted(at, places) % len(at)
    load, most = np.zeros(shards), (1 + slack) * sizes.sum() / shards
    out = np.zeros(len(sizes), np.int32)
    for i in np.lexsort((places, -sizes)):
        if load.min() + sizes[i] > most:
            out[i] = load.argmin()
        else:
            j = start[i]
            while load[owner[j]] + sizes[i] > most:
                j = (j + 1) % len(at)
            out[i] = owner[j]
        load[out[i]] += sizes[i]
    return out


def cell(hash_: Column, parts: int) -> Column:
    return F.pmod(hash_, F.lit(parts)).cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs`` (doc_id, text; others are not read).

    size is the text's UTF-8 bytes plus one, slot counts a shard's rows from 0 without gaps, law is 'bytes' and grown_shard null.
    Null texts count as empty. Rows that repeat an id or a text, and rows without id, are placed and numbered one by one.
    With fewer or larger texts than shards can share evenly, a shard may exceed the bound by one text. No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    slim = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
                            F.monotonically_increasing_id().alias("row")), "slim")
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    heavy = max(1.0, HEAVY * total / shards)
    kind = F.floor(F.log2("size")).cast("int")
    # three levels: place and size class; for heavy cells also a hash of the text; for heavy texts also one of the row
    rows = slim.withColumn("cell", F.xxhash64(cell(F.col("key"), CELLS), kind)).withColumn("place", F.xxhash64(cell(F.col("key"), CELLS), F.lit(1)))
    for level, split in enumerate((F.xxhash64("cell", cell(F.xxhash64("key", F.lit(2)), FINE)), F.xxhash64("cell", cell(F.xxhash64("row", F.lit(3)), FINE)))):
        big = [r[0] for r in rows.groupBy("cell").agg(F.sum("size").alias("size")).where(F.col("size") > heavy).select("cell").collect()]
        if big:  # fewer than shards / HEAVY cells can be this heavy
            rows = rows.withColumn("cell", F.when(F.col("cell").isin(big), split).otherwise(F.col("cell")))
            if level:
                rows = rows.withColumn("place", F.when(F.col("cell").isin(big), F.xxhash64("cell")).otherwise(F.col("place")))
    cells = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.min("place").alias("place")).toArrow()
    where = assign(cells.column("place").to_numpy().astype(np.int64).view(np.uint64), cells.column("size").to_numpy().astype(float), shards, nodes, slack)
    table = spark.createDataFrame(list(zip(cells.column("cell").to_pylist(), where.tolist())),
                                  T.StructType([T.StructField("cell", T.LongType()), T.StructField("shard", T.IntegerType())]))
    placed = kept(rows.join(F.broadcast(table), "cell").select("doc_id", "size", "text_crc32", "shard",
                                                               cell(F.xxhash64("row", F.lit(4)), SLOTS).alias("part")), "placed")
    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = parts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    out = (placed.withColumn("here", here).join(F.broadcast(before), ["shard", "part"])
           .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("here") - 1).alias("slot"),
                   F.lit(None).cast("int").alias("grown_shard")))
    drop(slim)
    return out
