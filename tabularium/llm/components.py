"""Connected components of links too many for one machine: union-find inside tasks, star contraction between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.store import drop, kept


def forest(batches):
    """The links of each Arrow batch reduced to one (node, root) row per node that is not its own root."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if parent[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())],
                                         names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node in ``links`` (two long columns); a component is named by its smallest node.

    Each round replaces links by stars around smaller neighbours (large star, then small star) until nothing changes; the
    number of rounds grows with the logarithm of the longest chain. Links to itself and repeated links do no harm, nulls
    are left out, an empty table gives an empty one. Rounds are written to the shared folder; no group is gathered.
    """
    a, b = links.columns[:2]
    stars = kept(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
                 .mapInArrow(forest, "node long, root long").distinct(), "links")
    seen = None
    while (mark := stars.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()) != seen:
        seen = mark
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("low"))
        large = (both.join(least, "node").where(F.col("root") > F.col("node"))
                 .select(F.col("root").alias("node"), F.least("low", "node").alias("root")))
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).where("node <> root")
        before, stars = stars, kept(small.unionByName(low.select("node", F.col("low").alias("root"))).distinct(), "links")
        drop(before)
    roots = stars.select(F.col("root").alias("node"), F.col("root").alias("component"))
    return stars.select("node", F.col("root").alias("component")).unionByName(roots.distinct())
