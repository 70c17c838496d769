"""Lexical retrieval packing: documents are packed into token windows next to documents that share their rare terms.

1. Each text becomes token ids plus an end id. Document frequencies of all ids are counted over all documents on the way.
2. Documents are dealt by content into shards of about ``shard_tokens`` tokens, so that a shard's inverted index always fits
   in one task, however many documents there are. Each gets a key: the KEY_TERMS weightiest of its terms that other documents
   hold too, commonest first, and last a hash of the row. Shards are ranges of keys between token quantiles of a sample, so
   hot terms are split by the next terms and equal texts by the hash. Terms are token ids, weighted by BM25 with the corpus-wide
   frequencies; all of a document's terms are posted, and all are queried.
3. In a shard, each seed document opens a window. Its unused neighbours in the index, best first, are put in whole while they
   fit; the best that does not fit is cut to fill the window exactly, and what remains of it seeds the next window. Without
   a neighbour, the next unused document in order is taken. A shard's last tokens are cut into windows whose sizes are powers
   of two. So no window needs padding at all.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm import words
from tabularium.llm.bpe import encoder
from tabularium.llm.store import kept

WINDOW, END = 2048, 1
SHARD_TOKENS = 2_000_000
KEY_TERMS = 8
#: Sampled documents for each shard, from whose keys the shards' limits are taken.
SAMPLED = 128
K1, B = 1.2, 0.75
#: Postings of used documents are taken out of an index when less than this share of its documents is unused.
LIVE = 0.8


def distinct_terms(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' distinct terms in order, as document numbers, terms and counts."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    if flat.dtype == np.uint16 and len(ids) <= 1 << 16:
        pairs, tf = np.unique(doc.astype(np.uint32) << np.uint32(16) | flat, return_counts=True)
        return (pairs >> np.uint32(16)).astype(np.int64), (pairs & np.uint32(0xFFFF)).astype(np.int64), tf
    pairs, tf = np.unique(doc.astype(np.uint64) << np.uint64(32) | flat.astype(np.uint64), return_counts=True)
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), tf


def tokenised(path: str):
    """One row per document with its ids (and the end id), and last one row per task with its document frequencies."""
    def make(batches):
        encode = encoder(path, "tiktoken")
        width = encode.width
        seen = np.zeros(encode.size, np.int64)
        for batch in batches:
            for part in words.slices(batch, "text", 1 << 20, 1024):
                ids = [np.r_[x, END].astype(width) for x in encode([t or "" for t in part.column("text").to_pylist()])]
                seen += np.bincount(distinct_terms(ids)[1], minlength=len(seen))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                                                  pa.array([x.tobytes() for x in ids]), pa.nulls(len(ids), pa.binary())],
                                                 names=["doc_id", "doc_tokens", "ids", "frequencies"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()])],
                                         names=["doc_id", "doc_tokens", "ids", "frequencies"])
    return make


def add(table: pa.Table) -> pa.Table:
    return pa.table({"frequencies": [sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("frequencies")).tobytes()]})


class Shard:
    """The inverted index of one shard's documents, and which of them are unused."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray):
        n = len(ids)
        self.size = np.array([len(x) for x in ids])
        doc, term, tf = distinct_terms(ids)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.size[doc] / self.size.mean()))).astype(np.float32)
        by_term = np.argsort(term, kind="stable")
        terms, first = np.unique(term[by_term], return_index=True)
        self.doc_term, self.doc_at = np.searchsorted(terms, term), np.searchsorted(doc, np.arange(n + 1))
        self.term_at, self.posting, self.weight = np.r_[first, len(by_term)], doc[by_term], weight[by_term].astype(np.float64)
        self.unused, self.posted = np.ones(n, bool), n
        self.next = 0

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a posting term with the seed, by falling score (ties by position)."""
        if np.count_nonzero(self.unused) < LIVE * self.posted:
            self.forget()
        wanted = self.doc_term[self.doc_at[seed]:self.doc_at[seed + 1]]
        spans = list(zip(self.term_at[wanted].tolist(), self.term_at[wanted + 1].tolist()))
        score = np.bincount(np.concatenate([self.posting[a:b] for a, b in spans]),
                            np.concatenate([self.weight[a:b] for a, b in spans]), len(self.size))
        score[~self.unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]

    def forget(self) -> None:
        """Takes the postings of used documents out of the index."""
        live = self.unused[self.posting]
        self.term_at = np.r_[0, np.cumsum(live)][self.term_at]
        self.posting, self.weight, self.posted = self.posting[live], self.weight[live], np.count_nonzero(self.unused)

    def first(self) -> int:
        """The next unused document in order, or -1."""
        while self.next < len(self.unused) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.unused) else -1


def packed(ids: list[np.ndarray], idf: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    shard = Shard(ids, idf)
    pieces, sequence, room = [], 0, window
    left = int(shard.size.sum())
    if left < window:
        room = 1 << left.bit_length() - 1

    def put(doc: int, start: int) -> int:
        """Puts what fits of a document from ``start`` on; returns where it stopped."""
        nonlocal sequence, room, left, used
        length = min(room, int(shard.size[doc]) - start)
        pieces.append((doc, start, length, sequence, used))
        room, left, used = room - length, left - length, used + length
        if not room:
            sequence, used = sequence + 1, 0
            room = window if left >= window else 1 << max(left.bit_length() - 1, 0)
        return start + length

    used, seed, start = 0, -1, 0
    while left:
        if seed < 0:
            seed, start = shard.first(), 0
            shard.unused[seed] = False
        at = sequence
        while start < shard.size[seed]:
            start = put(seed, start)
        if sequence != at and not used:
            seed = -1
            continue
        at, rest, i = sequence, -1, 0
        found = shard.neighbours(seed)
        sizes = shard.size[found]
        while i < len(found) and sequence == at:
            fits = sizes[i:] <= room
            skip = int(fits.argmax()) if fits.any() else len(fits)
            if skip and rest < 0:
                rest = found[i]
            i += skip
            if i < len(found):
                shard.unused[found[i]] = False
                put(int(found[i]), 0)
                i += 1
        if sequence != at or not left:
            seed = -1
            continue
        seed = int(rest) if rest >= 0 else shard.first()
        shard.unused[seed] = False
        start = 0
    return pieces


def term_keys(ids: list[np.ndarray], seen: np.ndarray, idf: np.ndarray, mean: float, row: np.ndarray) -> np.ndarray:
    """Each document's key in bytes that sort: its weightiest shared terms, commonest first, and ``row``."""
    key = np.full((len(ids), KEY_TERMS), 0xFFFFFFFF, ">u4")
    doc, term, tf = distinct_terms(ids)
    shared = seen[term] > 1
    doc, term, tf = doc[shared], term[shared], tf[shared]
    size = np.array([len(x) for x in ids])
    weight = idf[term] * tf / (tf + K1 * (1 - B + B * size[doc] / mean))
    at = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        terms, w = term[a:b], weight[a:b]
        if b - a > KEY_TERMS:
            high = np.flatnonzero(w >= np.partition(w, -KEY_TERMS)[-KEY_TERMS])
            terms, w = terms[high], w[high]
        top = terms[np.argsort(-w, kind="stable")[:KEY_TERMS]]
        key[i, :len(top)] = top[np.argsort(-seen[top], kind="stable")]
    out = np.empty((len(ids), 4 * KEY_TERMS + 8), np.uint8)
    out[:, :-8], out[:, -8:] = key.view(np.uint8).reshape(len(ids), -1), row.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view(f"S{out.shape[1]}").ravel()


def keyed(seen: np.ndarray, idf: np.ndarray, mean: float, width, limits: np.ndarray | None = None):
    """The key of each row, or with the limits between shards its shard and all that is packed."""
    def make(batches):
        for batch in batches:
            for part in words.slices(batch, "ids", 1 << 20, 1024):
                ids = [np.frombuffer(x, width) for x in part.column("ids").to_pylist()]
                key = term_keys(ids, seen, idf, mean, part.column("row").to_numpy().view(np.uint64))
                if limits is None:
                    yield pa.RecordBatch.from_arrays([pa.array([k.ljust(key.itemsize, b"\0") for k in key.tolist()], pa.binary()), part.column("doc_tokens")],
                                                     names=["key", "doc_tokens"])
                else:
                    shard = np.searchsorted(limits, key, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *(part.column(c) for c in ("doc_id", "doc_tokens", "ids", "order"))],
                                                     names=["shard", "doc_id", "doc_tokens", "ids", "order"])
    return make


def dealt(rows: DataFrame, seen: np.ndarray, idf: np.ndarray, n: int, tokens: int, width, shard_tokens: int) -> DataFrame:
    """``shard, doc_id, doc_tokens, ids, order``: rows in shards of about ``shard_tokens`` tokens, by keys."""
    count = max(1, -(-tokens // shard_tokens))
    order = F.crc32("ids")
    # the hash parts rows that repeat an id and a text, so that no shard can outgrow its share
    rows = rows.withColumn("order", order).withColumn("row", F.xxhash64("doc_id", order, F.monotonically_increasing_id()))
    if count == 1:
        return rows.select(F.lit(0).cast("long").alias("shard"), "doc_id", "doc_tokens", "ids", "order")
    mean = tokens / n
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(n)) < SAMPLED * count).mapInArrow(keyed(seen, idf, mean, width), "key binary, doc_tokens long").toArrow()
    key = np.array(some.column("key").to_pylist(), f"S{4 * KEY_TERMS + 8}")
    by = np.argsort(key, kind="stable")
    sums = np.cumsum(some.column("doc_tokens").to_numpy()[by])
    limits = key[by][np.searchsorted(sums, sums[-1] * np.arange(1, count) / count)] if len(key) else key
    return rows.mapInArrow(keyed(seen, idf, mean, width, limits), "shard long, doc_id long, doc_tokens long, ids binary, order long")


def shards(idf: np.ndarray, window: int, width):
    def pack(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("order", "ascending")])
        ids = [np.frombuffer(x.as_py(), width) for x in table.column("ids")]
        pieces = np.array(packed(ids, idf, window), np.int64)
        crc = [zlib.crc32(ids[d][s:s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
        doc = pa.array(pieces[:, 0])
        return pa.table({"doc_id": table.column("doc_id").take(doc), "start": pieces[:, 1], "length": pieces[:, 2],
                         "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": table.column("doc_tokens").take(doc),
                         "sequence_id": (key[0].as_py() << 32) + pieces[:, 3], "offset": pieces[:, 4]})
    return pack


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece of each row of ``docs``.

    Null and empty texts are the end id alone. Rows that repeat an id are documents of their own; null ids are kept. Texts of
    any length are cut into full windows. No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    made = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                .mapInArrow(tokenised(path), "doc_id long, doc_tokens long, ids binary, frequencies binary"), "tokens")
    parts = made.where("frequencies IS NOT NULL").select("frequencies").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    total = (parts.groupBy("salt").applyInArrow(add, "frequencies binary").groupBy().applyInArrow(add, "frequencies binary")).first()
    rows = made.where("ids IS NOT NULL").select("doc_id", "doc_tokens", "ids")
    n, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    size, width = encoder(path, "tiktoken").size, encoder(path, "tiktoken").width
    seen = np.frombuffer(total[0], np.int64) if total else np.zeros(size, np.int64)
    idf = np.log1p((n - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    return dealt(rows, seen, idf, n, tokens, width, shard_tokens).groupBy("shard").applyInArrow(
        shards(idf, window, width), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
