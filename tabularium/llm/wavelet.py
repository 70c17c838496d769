"""Token ids of a corpus in wavelet matrices: one compressed file per shard, with access, counting and lookup inside it.

A wavelet matrix holds n ids of L bits as L planes of n bits. Plane by plane from the highest bit, ids are dealt stably into those
with a 0 and those with a 1, so that rank and select on the planes answer everything: the id at a place (one rank per plane), how
often an id stands before a place, and where its k-th occurrence stands (one select per plane, upwards).

A file holds a header, the documents' ids and ends, and for each plane its number of zeros, the ones before every block and
the blocks themselves, each compressed on its own. A lookup decompresses one block per plane, not the file. Spark writes and commits the
files (Parquet with one row, so one shard, each), so they can lie in any store and lost tasks are run again.

Documents are range partitioned and sorted by doc_id, and tasks stream them into shards of about ``shard_tokens`` ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.llm import words
from tabularium.llm.bpe import encoder
from tabularium.llm.store import partitions
from tabularium.session import scratch_path

END = 0
SHARD_TOKENS = 1 << 22
#: Bytes of a plane that are compressed together: 65,536 bits.
BLOCK = 8192
MAGIC = b"WAVEMTX1"
HEAD = struct.Struct("<8sQIII")
SCHEMA = "part int, number int, first long, n_tokens long, n_docs int, matrix binary"


def pack(ids: np.ndarray, doc_ids: list, ends: np.ndarray, levels: int) -> bytes:
    """The file of one shard: ``ids`` of all documents, whose ids are ``doc_ids`` and which end at ``ends``."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], bool)
    docs = squeeze(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.asarray(ends, "<i8").tobytes() + np.packbits(known).tobytes())
    out = [HEAD.pack(MAGIC, len(ids), levels, len(doc_ids), len(docs)), docs]
    for bit in reversed(range(levels)):
        ones = (ids >> np.array(bit, ids.dtype) & np.array(1, ids.dtype)).astype(bool)
        plane = np.packbits(ones)
        blocks = [plane[at:at + BLOCK] for at in range(0, len(plane), BLOCK)]
        before = np.r_[0, np.cumsum([np.bitwise_count(b).sum(dtype=np.int64) for b in blocks])] if blocks else np.zeros(1, np.int64)
        small = [squeeze(b.tobytes()) for b in blocks]
        at = np.r_[0, np.cumsum([len(b) for b in small])]
        index = squeeze(before.astype("<i8").tobytes() + at.astype("<i8").tobytes())
        out += [struct.pack("<II", len(blocks), len(index)), index, *small]
        ids = np.concatenate([ids[~ones], ids[ones]])
    return b"".join(out)


class Plane:
    """The bits of one level, block by block."""

    def __init__(self, data: memoryview, n: int, before: np.ndarray, at: np.ndarray):
        self.data, self.n, self.before, self.at = data, n, before, at
        self.ones = int(before[-1])
        self.zeros = n - self.ones
        self.block = lru_cache(16)(self._block)

    def _block(self, i: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.at[i]:self.at[i + 1]], max_output_size=BLOCK)
        return np.frombuffer(raw, np.uint8)

    def bit(self, place: int) -> int:
        i, rest = divmod(place, 8 * BLOCK)
        return int(self.block(i)[rest >> 3] >> (7 - (rest & 7)) & 1)

    def rank(self, bit: int, place: int) -> int:
        """How many of the first ``place`` bits are ``bit``."""
        i, rest = divmod(place, 8 * BLOCK)
        ones = int(self.before[i])
        if rest:
            block = self.block(i)
            ones += int(np.bitwise_count(block[:rest >> 3]).sum(dtype=np.int64))
            if rest & 7:
                ones += int(block[rest >> 3] >> (8 - (rest & 7))).bit_count()
        return ones if bit else place - ones

    def select(self, bit: int, k: int) -> int:
        """The place of the k-th (from 0) ``bit``."""
        size = 8 * BLOCK
        before = self.before if bit else np.minimum(np.arange(len(self.before)) * size, self.n) - self.before
        i = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.block(i), count=min(size, self.n - i * size))
        return i * size + int(np.flatnonzero(bits == bit)[k - int(before[i])])

    def bits(self) -> np.ndarray:
        """All bits as booleans."""
        whole = np.concatenate([self._block(i) for i in range(len(self.at) - 1)]) if len(self.at) > 1 else np.zeros(0, np.uint8)
        return np.unpackbits(whole, count=self.n).astype(bool)


class Matrix:
    """A shard's file opened for reading."""

    def __init__(self, data: bytes):
        magic, self.n, self.levels, n_docs, size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no wavelet matrix")
        view, at = memoryview(data), HEAD.size
        expand = zstandard.ZstdDecompressor().decompress
        docs = expand(view[at:at + size])
        at += size
        self.ends = np.frombuffer(docs, "<i8", n_docs, 8 * n_docs)
        known = np.unpackbits(np.frombuffer(docs, np.uint8, offset=16 * n_docs), count=n_docs).astype(bool)
        self.doc_ids = pa.array(np.frombuffer(docs, "<i8", n_docs), mask=~known)
        self.planes = []
        for _ in range(self.levels):
            blocks, size = struct.unpack_from("<II", data, at)
            index = np.frombuffer(expand(view[at + 8:at + 8 + size]), "<i8")
            at += 8 + size
            before, places = index[:blocks + 1], index[blocks + 1:]
            self.planes.append(Plane(view[at:at + int(places[-1])], self.n, before, places))
            at += int(places[-1])

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        found = 0
        for plane in self.planes:
            bit = plane.bit(place)
            found = found << 1 | bit
            place = plane.zeros * bit + plane.rank(bit, place)
        return found

    def span(self, token: int, place: int) -> tuple[int, int]:
        """Where the occurrences of an id before ``place`` lie in the last level: they are neighbours there."""
        if token < 0 or token >> self.levels:
            return 0, 0
        low, high = 0, place
        for level, plane in enumerate(self.planes):
            bit = token >> (self.levels - 1 - level) & 1
            low, high = plane.zeros * bit + plane.rank(bit, low), plane.zeros * bit + plane.rank(bit, high)
        return low, high

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id stands in ``start`` to ``end``."""
        end = self.n if end is None else min(end, self.n)
        first, last = self.span(token, max(0, start)), self.span(token, max(0, end))
        return max(0, last[1] - first[1])

    def select(self, token: int, k: int) -> int:
        """The place of an id's k-th (from 0) occurrence, or -1."""
        low, high = self.span(token, self.n)
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for level in reversed(range(self.levels)):
            plane, bit = self.planes[level], token >> (self.levels - 1 - level) & 1
            at = plane.select(bit, at - plane.zeros * bit)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, ascending."""
        low, high = self.span(token, self.n)
        at = np.arange(low, high)
        for level in reversed(range(self.levels)):
            if not len(at):
                break
            plane, bit = self.planes[level], token >> (self.levels - 1 - level) & 1
            at = np.flatnonzero(plane.bits() == bool(bit))[at - plane.zeros * bit]
        return at

    def tokens(self) -> np.ndarray:
        """All ids in order: planes are dealt back from the lowest to the highest."""
        ids = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            plane = self.planes[level]
            ones = plane.bits()
            whole = np.empty_like(ids)
            whole[~ones] = ids[:plane.zeros]
            whole[ones] = ids[plane.zeros:] | np.array(1 << (self.levels - 1 - level), ids.dtype)
            ids = whole
        return ids


def shards(path: str, shard_tokens: int):
    """Streams sorted documents into files; a file is closed after the document that reaches ``shard_tokens``."""
    def make(batches) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([END], encode.width)
        part, state = TaskContext.get().partitionId(), {"number": 0, "first": 0}
        ids, docs, size = [], [], 0

        def close():
            whole = np.concatenate(ids)
            ends = np.cumsum([len(x) for x in ids])
            row = [part, state["number"], state["first"], len(whole), len(docs), pack(whole, docs, ends, (encode.size - 1).bit_length())]
            state.update(number=state["number"] + 1, first=state["first"] + len(whole))
            names = ["part", "number", "first", "n_tokens", "n_docs", "matrix"]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for rows in words.slices(batch, "text", 1 << 20, 1024):
                for doc, found in zip(rows.column("doc_id").to_pylist(), encode([t or "" for t in rows.column("text").to_pylist()])):
                    ids.append(np.concatenate([found, end]))
                    docs.append(doc)
                    size += len(ids[-1])
                    if size >= shard_tokens:
                        yield close()
                        ids, docs, size = [], [], 0
        if docs:
            yield close()
    return make


def write(docs: DataFrame, tokenizer: str, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of all rows of ``docs`` (doc_id and text; other columns are not read), each with the end id 0, into ``path``.

    Documents go in ascending doc_id order, null ids first. Null and empty texts are the end id alone. Rows that repeat an id are
    documents of their own, ordered by a hash of their text; copies of one row may go to different shards. A text of any length
    lies in one shard. No rows give a folder without shards.
    """
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    (rows.drop("row").mapInArrow(shards(tokenizer, shard_tokens), SCHEMA)
     .write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: ``part, number, first, n_tokens, n_docs, matrix`` and ``start``, the ids in all shards before it."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # one row per written partition
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    return files.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def summaries(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("matrix")):
            matrix = Matrix(data.as_py())
            ids = matrix.tokens()
            begins = np.r_[0, matrix.ends[:-1]]
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), matrix.ends.tolist())]
            yield pa.RecordBatch.from_arrays([matrix.doc_ids, pa.array(start + begins, pa.int64()), pa.array(matrix.ends - begins, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    return read(spark, path).select("start", "matrix").mapInArrow(summaries, "doc_id long, start long, n_tokens long, ids_crc32 long")


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each of a few ids stands in the corpus, by rank on each shard's planes."""
    wanted = sorted(set(tokens))

    def count(batches):
        for batch in batches:
            for data in batch.column("matrix"):
                matrix = Matrix(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([matrix.count(t) for t in wanted], pa.int64())], names=["token", "n"])
    return spark.read.schema(SCHEMA).parquet(path).select("matrix").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``doc_id, place, position``: an id's places in its documents and in the whole corpus, by select on each shard's planes."""
    def find(batches):
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("matrix")):
                matrix = Matrix(data.as_py())
                at = matrix.occurrences(token)
                doc = np.searchsorted(matrix.ends, at, side="right")
                yield pa.RecordBatch.from_arrays([matrix.doc_ids.take(pa.array(doc)), pa.array(at - np.r_[0, matrix.ends][doc], pa.int64()), pa.array(start + at, pa.int64())],
                                                 names=["doc_id", "place", "position"])
    return read(spark, path).select("start", "matrix").mapInArrow(find, "doc_id long, place long, position long")


def written(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> str:
    """``write`` into a fresh folder of the shared scratch folder, whose path is returned."""
    path = scratch_path(docs.sparkSession, "wavelet")
    write(docs, tokenizer, path, shard_tokens)
    return path
