"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find groups.

A document's set holds its distinct runs of five words (the whole sequence if there are fewer words, nothing without
words). Two documents are linked if their sets' Jaccard similarity reaches the threshold. Empty sets are linked with nothing.

1. One pass over the texts makes for each document its set's size, a 128-bit digest of the set and a SuperMinHash signature.
   Equal sets are one node, named by the smallest doc_id, so that copies cost nothing further on.
2. Signatures are cut into bands. Within each bucket of a band, every node is compared with the bucket's smallest node
   (a star, never all pairs) on the full sets, and verified links are united.
3. Buckets in which more than one component is left are compared in bounded tiles by their signatures. Nodes with a partner of
   another component whose estimate is within six standard deviations of the threshold meet again in the same tile with their
   full sets, and the tile emits its forest of verified links. No pairs become rows, and no candidate is capped.

With 32 bands of 8 rows a pair of similarity 0.85 misses all bands with probability 4e-5; nothing below the threshold is linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm import words
from tabularium.llm.components import components, forest
from tabularium.llm.store import drop, kept

BANDS, ROWS = 32, 8
TILE = 512
#: Of the filter that goes to every task: 2 MB.
FILTER_BITS = 1 << 24
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(values: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (n, m) of n sets of 64-bit hashes that lie one after another.

    Each element draws a random permutation of the m slots, one swap per round; in round j it puts j plus a random
    fraction, packed into one integer, into the slot it draws, and slots keep their minimum. A later round can only put
    larger values, so a set drops out as soon as all of its slots are filled.
    """
    n = len(at) - 1
    sig = np.full(n * m, EMPTY)
    doc = np.repeat(np.arange(n), np.diff(at))
    live, perm = values, None
    for j in range(m):
        if not len(live):
            break
        draw = words.mix(live + words.GOLDS[j + 1])
        pick = j + ((draw & np.uint64(0xFFFFFF)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
        slot = pick if perm is None else perm[np.arange(len(live)), pick]
        np.minimum.at(sig, doc * m + slot, np.uint64(j) << np.uint64(54) | draw >> np.uint64(10))
        open_ = (sig.reshape(n, m) == EMPTY).any(axis=1)[doc]
        if perm is None:
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(open_.sum()), m)).copy()
        else:
            perm = perm[open_]
        live, doc, pick = live[open_], doc[open_], pick[open_]
        rows = np.arange(len(live))
        perm[rows, j], perm[rows, pick] = perm[rows, pick], perm[rows, j].copy()
    return sig.reshape(n, m)


def bands_of(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash per band, different for equal rows in different bands."""
    parts = sig.reshape(len(sig), bands, -1)
    acc = words.mix(np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]))
    for r in range(parts.shape[2]):
        acc = words.mix(acc * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return acc


def features(bands: int, rows: int, k: int):
    def make(batches):
        for batch in batches:
            for part in words.slices(batch, "text", 1 << 18, 256):
                values, at = words.shingle_sets(part.column("text"), k)
                some = np.diff(at) > 0
                sums = [np.r_[np.uint64(0), np.cumsum(words.mix(values ^ np.uint64(seed)))] for seed in (1, 2)]
                sig = superminhash(values, at, bands * rows)
                hashes = bands_of(sig, bands).view(np.int64)
                marks = (sig ^ sig >> np.uint64(17)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums),
                     pa.array([h if ok else [] for h, ok in zip(hashes, some)], pa.list_(pa.int64())),
                     pa.array([x.tobytes() for x in marks], pa.binary())],
                    names=["doc_id", "n_shingles", "high", "low", "bands", "marks"])
    return make


def similar(threshold_pct: int, k: int):
    """Keeps the pairs whose full sets reach the threshold; equal neighbouring texts are parsed once per batch."""
    def check(batches):
        for batch in batches:
            for part in words.slices(batch, "text_a", 1 << 18, 256):
                sets = {}
                for side in ("a", "b"):
                    ids = part.column(side).to_numpy(zero_copy_only=False)
                    _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
                    values, at = words.shingle_sets(part.column(f"text_{side}").take(pa.array(first)), k)
                    sets[side] = values, at, inverse
                ok = []
                for i in range(part.num_rows):
                    x, y = (v[at[inv[i]]:at[inv[i] + 1]] for v, at, inv in sets.values())
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= threshold_pct * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return check


def verified(pairs: DataFrame, texts: DataFrame, threshold_pct: int, k: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold, written."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return kept(pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
                .mapInArrow(similar(threshold_pct, k), "a long, b long").distinct(), "links")


def candidates(limit: float):
    """The nodes of a tile that agree with one of another component on at least ``limit`` of the slots and share no band before
    this one with it, so that each pair counts in one bucket."""
    def compare(key, table):
        block, node, comp = (table.column(c).to_numpy() for c in ("block", "node", "component"))
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(node), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        band = int(np.argmax(bands[0] == key[0].as_py()))
        rows, cols = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        some = np.zeros(len(node), bool)
        for i in rows:
            to = cols[comp[cols] != comp[i]]
            to = to[(marks[to] == marks[i]).mean(axis=1) >= limit]
            to = to[~(bands[to, :band] == bands[i, :band]).any(axis=1)]
            some[to] = True
            some[i] |= len(to) > 0
        return table.filter(pa.array(some)).drop_columns(["marks", "bands", "block"])
    return compare


def confirmed(threshold_pct: int, k: int):
    """The forest of links between different components in a tile, by an inverted index of the members' full sets."""
    def compare(key, table):
        node, comp = table.column("node").to_numpy(), table.column("component").to_numpy()
        values, at = words.shingle_sets(table.column("text"), k)
        size = np.diff(at)
        _, term, often = np.unique(values, return_inverse=True, return_counts=True)
        order = np.argsort(term, kind="stable")
        member, first = np.repeat(np.arange(len(node)), size)[order], np.r_[0, np.cumsum(often)]
        a, b = [], []
        for i in range(len(node)):
            own = term[at[i]:at[i + 1]]
            own = own[often[own] > 1]
            count = often[own]
            reach = np.repeat(first[own] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            both = np.bincount(member[reach], minlength=len(node))
            near = (both > 0) & (100 * both >= threshold_pct * (size[i] + size - both)) & (comp != comp[i])
            near[:i + 1] = False
            b.append(node[near])
            a.append(np.full(len(b[-1]), node[i]))
        links = pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        return pa.Table.from_batches(list(forest([links]))).rename_columns(["b", "a"])
    return compare


def maybe_in(ids: DataFrame, bits: int = FILTER_BITS):
    """A Bloom filter over one long column, as a column function: false only for values that are not there.

    Two bits are set per value in ``bits`` bits, whatever the number of values; more values only let more through. It keeps
    most of the other rows' texts out of the shuffle of the join that decides.
    """
    place = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits))
    value = F.col(ids.columns[0])
    places = ids.select(F.explode(F.array(place(value, 1), place(value, 2))).alias("bit"))
    one = F.expr("shiftleft(1L, CAST(pmod(bit, 64) AS INT))")
    rows = places.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("mask")).toArrow()
    mask = np.zeros(bits // 64, np.int64)
    mask[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    table = mask.view(np.uint64)

    def test(first: pa.Array, second: pa.Array) -> pa.Array:
        hit = np.ones(len(first), bool)
        for at in (first.to_numpy(), second.to_numpy()):
            hit &= (table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pa.array(hit, pa.bool_())

    return lambda column: F.arrow_udf(test, "boolean")(place(F.col(column), 1), place(F.col(column), 2))


def near_duplicates(docs: DataFrame, threshold_pct: int = 85, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (columns doc_id and text; others are not read).

    component_id is the smallest doc_id that links reach; kept says that it is the document's own. Null texts are empty. A
    row without doc_id is linked with nothing: its component_id is null and it is kept. Rows that repeat a doc_id are one
    document, linked through each of its texts, and each of its rows is returned. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = kept(docs.mapInArrow(features(bands, rows, k), "doc_id long, n_shingles long, high long, low long, bands array<long>, marks binary"),
                "features")
    full = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["high", "low", "n_shingles"]
    nodes = full.groupBy(*digest).agg(F.min("doc_id").alias("node"))
    member = kept(full.select("doc_id", *digest).join(nodes, digest).select("doc_id", "node"), "members")
    own = full.select(F.col("doc_id").alias("node"), "bands", "marks").join(member.where("doc_id = node").select("node"), "node", "left_semi")
    spread = kept(own.select("node", F.explode("bands").alias("band")), "bands")
    crowd = spread.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "low")
    bucket = kept(spread.join(crowd, "band"), "buckets")
    # every node that shares a bucket, and so all texts that are read from here on
    crowded = kept(bucket.select(F.col("node").alias("doc_id")).distinct(), "crowded")
    texts = kept(docs.where(maybe_in(crowded)("doc_id")).join(crowded, "doc_id", "left_semi"), "texts")
    links = verified(bucket.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")), texts, threshold_pct, k)
    drop(spread)
    labels = kept(components(links.unionByName(member.where("doc_id <> node").toDF("b", "a").select("a", "b"))), "labels")
    named = bucket.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    left = kept(named.join(left.select("band", "size"), "band").select("band", "node", "component", "size"), "left")
    if left.head(1):
        blocks = F.ceil(F.col("size") / TILE).cast("int")
        marked = left.join(own, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        tiles = marked.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
            "band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "component", "marks", "bands")
        j = threshold_pct / 100
        limit = j - 6 * (j * (1 - j) / (bands * rows)) ** 0.5
        near = kept(tiles.groupBy("band", "one", "two").applyInArrow(candidates(limit), "band long, one int, two int, node long, component long"), "near")
        more = kept(near.join(texts.withColumnRenamed("doc_id", "node"), "node").groupBy("band", "one", "two").applyInArrow(confirmed(threshold_pct, k), "a long, b long").distinct(), "links")
        drop(near)
        if more.head(1):
            before = labels
            labels = kept(components(before.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)), "labels")
            drop(before)
        drop(more)
    drop(left, bucket, links, texts, crowded)
    return (made.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
