"""Embedding near-duplicates by sorted projection passes.

1. Vectors that are null or zero or hold null or non-finite components link with nothing. Equal vectors are one node, named
   by the smallest vec_id, so that copies cost nothing further on.
2. In each pass, nodes are sorted by the concatenated signs of random projections, most significant first, and each node is
   compared in double precision with its neighbours in a bounded window of that order. Verified links are united inside
   the task at once, so a task emits at most one link per node and batch however dense a group is; links of all passes are
   united afterwards. A pass brings two vectors at cosine 0.95 together with a probability of about
   (rows / window) ** -0.15, so the number of passes follows from the row count and the wanted probability of a miss.
3. Links are counted inside components, where all of them lie: members are compared block against block in bounded tiles,
   which emit one partial count per member. So a count is complete even where a group is larger than any window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.components import components
from tabularium.llm.store import drop, kept, partitions

BITS, WINDOW, BLOCK, TILE = 48, 512, 1024, 2048
MISS = 1e-6
PER_JOB = 4


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision, from vectors of equal length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys(passes: list[int], bits: int, seed: int):
    """For each vector and pass the signs of its projections as one integer."""
    def make(batches):
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = matrix(part.column("embedding"))
                for p in passes:
                    planes = np.random.default_rng([seed, p, int(dim)]).normal(size=(int(dim), bits))
                    signs = x @ planes > 0
                    key = (signs << np.arange(bits)[::-1]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(np.full(len(x), dim, np.int32)), pa.array(key),
                                                      part.column("node"), part.column("embedding")], names=["pass", "dim", "key", "node", "embedding"])
    return make


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id in each row's component of a boolean link matrix."""
    low = ids.copy()
    while True:
        near = np.minimum(low, np.where(linked, low, np.iinfo(np.int64).max).min(axis=1))
        if (near == low).all():
            return low
        low = near


def sweep(threshold: float, window: int, block: int):
    """Compares sorted nodes with the ``window`` nodes before them, block by block, and emits each block's forest of links."""
    def compare(batches):
        mark, ids, x = None, np.zeros(0, np.int64), None
        for batch in batches:
            group = np.stack([batch.column("pass").to_numpy(), batch.column("dim").to_numpy()], axis=1)
            cuts = np.r_[0, np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, len(group)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                for at in range(a, b, block):
                    part = batch.slice(at, min(block, b - at))
                    new, here = matrix(part.column("embedding")), part.column("node").to_numpy()
                    if mark is not None and mark == tuple(group[a]):
                        x, ids = np.concatenate([x[-window:], new]), np.concatenate([ids[-window:], here])
                    else:
                        mark, x, ids = tuple(group[a]), new, here
                    linked = x @ x.T >= threshold
                    low = roots(linked, ids)
                    some = low != ids
                    yield pa.RecordBatch.from_arrays([pa.array(low[some]), pa.array(ids[some])], names=["a", "b"])
    return compare


def counts(threshold: float):
    """For each member of a tile the weight of the linked members in the other block (or in its own, without itself)."""
    def count(key, table):
        x, block = matrix(table.column("embedding")), table.column("block").to_numpy()
        weight, node = table.column("weight").to_numpy().astype(np.float64), table.column("node").to_numpy()
        one, two = key[1].as_py(), key[2].as_py()
        rows, cols = block == one, block == two
        linked = x[rows] @ x[cols].T >= threshold
        if one == two:
            np.fill_diagonal(linked, False)
            return pa.table({"node": node, "links": (linked @ weight).astype(np.int64)})
        return pa.table({"node": np.r_[node[rows], node[cols]],
                         "links": np.r_[linked @ weight[cols], linked.T @ weight[rows]].astype(np.int64)})
    return count


def passes_for(rows: int, window: int, threshold: float, miss: float) -> int:
    """Passes after which a pair at the threshold has been outside every window with probability ``miss`` at most."""
    agree = 1 - math.acos(threshold) / math.pi
    together = agree ** max(1.0, math.log2(max(2, rows / window)) + 1)
    return max(4, math.ceil(math.log(miss) / math.log(1 - together)))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, window: int = WINDOW, miss: float = MISS, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (columns vec_id and embedding; others are not read).

    n_links counts the other rows linked directly (cosine of the threshold or more), component_id is the smallest vec_id that
    links reach, kept says that it is the row's own. Vectors of different lengths are not linked. Null, zero and non-finite
    vectors and rows without vec_id have no links and are kept. Rows that repeat a vec_id with one vector count as copies of
    it; with different vectors they are one vec_id in components, and links are counted for each vector. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
              & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    kinds = vectors.schema["embedding"].dataType
    real = rows.where(F.coalesce(usable, F.lit(False))).withColumn("embedding", F.col("embedding").cast(kinds))
    nodes = kept(real.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
                 .withColumn("mark", F.xxhash64("embedding")), "nodes")
    member = kept(real.withColumn("mark", F.xxhash64("embedding")).join(nodes, ["mark", "embedding"]).select("vec_id", "node", "weight"), "members")
    n = nodes.count()
    total = passes_for(n, window, threshold, miss)
    found = []
    for first in range(0, total, PER_JOB):
        some = list(range(first, min(total, first + PER_JOB)))
        spread = nodes.select("node", "embedding").mapInArrow(keys(some, BITS, seed), spread_schema(kinds))
        order = ["pass", "dim", "key", "node"]
        parts = max(1, min(partitions(spark), math.ceil(n * len(some) / (16 * window))))
        found.append(kept(spread.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                          .mapInArrow(sweep(threshold, window, BLOCK), "a long, b long").distinct(), "links"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    labels = kept(components(links), "labels")
    grouped = kept(nodes.join(labels, "node"), "grouped")
    sizes = grouped.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    placed = grouped.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "weight", "embedding")
    counted = (tiles.groupBy("component", "one", "two").applyInArrow(counts(threshold), "node long, links long")
               .groupBy("node").agg(F.sum("links").alias("links")))
    same = components(member.where("vec_id <> node").select("node", "vec_id").unionByName(labels.select("component", "node").toDF("node", "vec_id")))
    done = (member.join(counted, "node", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
            .join(same.toDF("vec_id", "component_id"), "vec_id", "left"))
    rest = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = done.unionByName(rest).select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    out = kept(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "vectors")
    drop(nodes, member, labels, grouped, *found)
    return out


def spread_schema(kind) -> str:
    return f"pass int, dim int, key long, node long, embedding {kind.simpleString()}"
