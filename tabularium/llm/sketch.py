"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every distinct shingle hash below a fixed share of the hash range. Its size follows the document's, so
two fingerprints estimate how much of the smaller document lies in the larger one however unequal they are, and the union of
two fingerprints, hash by hash, is the fingerprint of both texts together. As text, it is the number of shingles and a digest of them
all in hex, then the kept hashes in ascending order, base64 of little-endian 64-bit numbers.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm import words
from tabularium.llm.store import partitions

SHINGLE, SHARE = 5, 0.25


def sketches(texts: pa.Array, k: int = SHINGLE, share: float = SHARE) -> tuple[list[str], list[np.ndarray]]:
    """The fingerprint of each text, and its kept hashes. Null counts as empty; fewer than k words are one shingle."""
    values, at = words.shingle_sets(texts, k)
    values = words.mix(values ^ np.uint64(0x5BF03635))
    digest = np.r_[np.uint64(0), np.cumsum(words.mix(values))]
    digest = digest[at[1:]] - digest[at[:-1]]
    limit = np.uint64(min(int(share * 2 ** 64), 2 ** 64 - 1))
    kept = [np.sort(v[v <= limit]) for v in (values[a:b] for a, b in zip(at[:-1], at[1:]))]
    marks = [f"{n:x}.{int(d):016x}.{base64.b64encode(x.astype('<u8').tobytes()).decode()}" for n, d, x in zip(np.diff(at), digest, kept)]
    return marks, kept


def hashes(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.rpartition(".")[2]), "<u8")


def contained(one: np.ndarray, other: np.ndarray, same: bool) -> float:
    """The share of the smaller sketch that the other has; without hashes on a side only equal texts are alike."""
    if same:
        return 1.0
    least = min(len(one), len(other))
    return len(np.intersect1d(one, other, assume_unique=True)) / least if least else 0.0


def likeness(one: str, other: str) -> float:
    """Estimated containment, 0 to 1, of the smaller of two fingerprinted texts in the other."""
    return contained(hashes(one), hashes(other), one == other)


def fingerprinted(docs: DataFrame, column: str = "fingerprint", text: str = "text", k: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """``docs`` with the fingerprint of a text column; all other columns stay."""
    def make(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([m for p in words.slices(batch, "text") for m in sketches(p.column("text"), k, share)[0]], pa.string())
    return docs.withColumn(column, F.arrow_udf(make, "string")(F.col(text).cast("string")))


def edited(k: int, share: float):
    """Rows in order, with a guest row at the end of each bucket that only serves as the last row's next."""
    def finish(part: pa.RecordBatch, after: str | None, marks: list[str], kept: list[np.ndarray]) -> pa.RecordBatch:
        texts = [t or "" for t in part.column("text").to_pylist()]
        nexts = [*texts[1:], after]
        n = len(texts) - (after is None)
        changed = [t[:len(t) - len(t) // 2] + x[:len(t) // 2] for t, x in zip(texts[:n], nexts)]
        new_marks, new_kept = sketches(pa.array(changed, pa.string()), k, share) if n else ([], [])
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").slice(0, n), pa.array([len(t) for t in texts[:n]], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array(marks[:n], pa.string()), pa.array(new_marks, pa.string()),
             pa.array([contained(kept[i], new_kept[i], marks[i] == new_marks[i]) for i in range(n)], pa.float64()),
             pa.array([contained(kept[i], kept[i + 1], marks[i] == marks[i + 1]) for i in range(n)], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def runs(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", 1 << 19, 512):
                bucket = part.column("bucket").to_numpy()
                cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    yield part.slice(a, b - a)

    def make(batches):
        held = None
        for part in runs(batches):
            marks, kept = sketches(part.column("text"), k, share)
            if held is not None:
                before, old_marks, old_kept = held
                if before.column("bucket")[0] == part.column("bucket")[0]:
                    yield finish(before, part.column("text")[0].as_py() or "", [*old_marks, marks[0]], [*old_kept, kept[0]])
                else:
                    yield finish(before, None, old_marks, old_kept)
            held = part, marks, kept
        if held is not None:
            yield finish(held[0], None, *held[1:])
    return make


def with_edits(docs: DataFrame, k: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row of ``docs``.

    A row's edited text has its last half (code points, rounded down) replaced by as much of the next row's beginning; rows are
    ordered by doc_id (null first), then by a hash of the text, and the first follows the last; a lone row follows itself.
    Null texts are empty. Rows are dealt to tasks by ranges of doc_id, and each range also gets the first row of the one after
    it: one row per range is collected, and texts are shuffled once. No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(lowest)).alias("pos"), F.xxhash64("text").alias("tie"))
    parts = partitions(spark)
    bounds = np.unique(docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
                       if parts > 1 else []).astype(np.int64)

    def place(pos: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, pos.to_numpy(), "right"), pa.int32())

    rows = rows.withColumn("bucket", F.arrow_udf(place, "int")("pos"))
    heads = sorted(rows.groupBy("bucket").agg(F.min(F.struct("pos", "tie")).alias("first")).collect())
    guests = [(r.first.pos, r.first.tie, heads[i - 1].bucket) for i, r in enumerate(heads)]
    table = spark.createDataFrame(guests, T.StructType([T.StructField("pos", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("bucket", T.IntegerType())]))
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(rows.drop("bucket").join(F.broadcast(table), ["pos", "tie"]).withColumn("guest", F.lit(1)))
    return (dealt.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "guest", "pos", "tie").mapInArrow(
        single_guest(edited(k, share)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))


def single_guest(make):
    """Leaves one guest row of each bucket: repeated rows at a range's beginning come as several."""
    def once(batches):
        seen = None
        for batch in batches:
            bucket, guest = batch.column("bucket").to_numpy(), batch.column("guest").to_numpy()
            keep = np.ones(len(bucket), bool)
            for i in np.flatnonzero(guest):
                keep[i] = seen != bucket[i]
                seen = bucket[i]
            if keep.any():
                yield batch.filter(pa.array(keep))

    def run(batches):
        return make(once(batches))
    return run
