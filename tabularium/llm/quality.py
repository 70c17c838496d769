"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated scores.

Units are words (lower-cased, hashed to 2**13 rows) and word shapes (runs of capitals, other letters and digits written as
one mark each, symbols kept, and whether the word repeats the one before; hashed to 2**11 rows). Each unit has a sparse
random index vector; its context vector is the sum of the index vectors of its neighbours up to two places away, over all
documents. A document is the mean of its units' vectors, rare units counting more, for words and shapes apart.

Word vectors come from every document. The network is fitted on the driver on at most ``labelled.MOST_ROWS`` pooled
vectors of labelled documents outside the held-out part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm import words
from tabularium.llm.labelled import MOST_ROWS, Network, teaching

WORDS, SHAPES, DIM, MARKS, REACH = 1 << 13, 1 << 11, 32, 2, 2
UNITS, BLOCKS = WORDS + SHAPES, 8
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 65, 97, 97, 48
_draws = words.mix(np.arange(UNITS * MARKS, dtype=np.uint64) + np.uint64(1 << 40))
PLACE = (_draws % np.uint64(DIM)).astype(np.int64).reshape(UNITS, MARKS)
SIGN = np.where(_draws >> np.uint64(63), 1.0, -1.0).reshape(UNITS, MARKS)


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, shape rows (both one per word) and the n + 1 places where documents begin and end."""
    data, at = words.text_bytes(texts)
    begin, end, docs = words.word_bounds(data, at)
    hashes = words.span_hashes(words.LOWER[data], begin, end)
    kind = KIND[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[begin] = True
    place = np.r_[0, np.cumsum(keep)]
    shapes = words.span_hashes(kind[keep], place[begin], place[end])
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[docs[:-1][docs[:-1] < len(again)]] = False
    shapes = words.mix(shapes + again)
    return (hashes % np.uint64(WORDS)).astype(np.int64), (shapes % np.uint64(SHAPES)).astype(np.int64) + WORDS, docs


def gather(batches):
    """One row per block of units: the sums of neighbours' index vectors, and last the unit's count, over a whole task."""
    total = np.zeros((UNITS, DIM + 1))
    for batch in batches:
        for part in words.slices(batch, "text"):
            *kinds, docs = units(part.column("text"))
            doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
            for unit in kinds:
                total[:, DIM] += np.bincount(unit, minlength=UNITS)
                for gap in range(1, REACH + 1):
                    near = doc[gap:] == doc[:-gap]
                    a, b = unit[:-gap][near], unit[gap:][near]
                    for one, other in ((a, b), (b, a)):
                        for k in range(MARKS):
                            total[:, :DIM] += np.bincount(one * DIM + PLACE[other, k], SIGN[other, k], UNITS * DIM).reshape(UNITS, DIM)
    for block, rows in enumerate(np.split(total, BLOCKS)):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rows.astype(np.float32).tobytes()])], names=["block", "sums"])


def add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("sums"))
    return pa.table({"block": table.column("block").slice(0, 1), "sums": [total.astype(np.float32).tobytes()]})


def contexts(docs: DataFrame) -> np.ndarray:
    """Context sums and counts (UNITS, DIM + 1) over all texts; tasks' tables of fixed size are added up in two rounds."""
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(gather, "block int, sums binary")
    sums = (parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("block", "salt").groupBy("block", "salt")
            .applyInArrow(add, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary"))
    rows = {r.block: np.frombuffer(r.sums, np.float32) for r in sums.collect()}
    empty = np.zeros(UNITS // BLOCKS * (DIM + 1), np.float32)
    return np.concatenate([rows.get(b, empty) for b in range(BLOCKS)]).reshape(UNITS, DIM + 1)


class Pooling:
    """Turns texts into vectors: means of word and shape vectors, weighted by rarity, and the logarithm of the word count."""

    def __init__(self, sums: np.ndarray):
        own = np.zeros((UNITS, DIM))
        np.add.at(own, (np.arange(UNITS)[:, None], PLACE), SIGN)
        size = np.linalg.norm(sums[:, :DIM], axis=1, keepdims=True)
        share = sums[:, DIM] / max(1.0, float(sums[:WORDS, DIM].sum()))
        weight = 1e-2 / (1e-2 + share)
        self.vectors = ((sums[:, :DIM] / np.maximum(size, 1e-9) + own / MARKS ** 0.5) * weight[:, None]).astype(np.float32)

    def pool(self, texts: pa.Array) -> np.ndarray:
        *kinds, docs = units(texts)
        count = np.diff(docs)
        out = np.zeros((len(count), 2 * DIM + 1))
        full = np.flatnonzero(count)
        for i, unit in enumerate(kinds):
            if len(full):
                out[full, i * DIM:(i + 1) * DIM] = np.add.reduceat(self.vectors[unit], docs[:-1][full], axis=0) / count[full, None]
        out[:, -1] = np.log1p(count)
        return out

    def __call__(self, batches):
        for batch in batches:
            for part in words.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(self.pool(part.column("text"))), pa.list_(pa.float64()))], names=["y", "vector"])


class Quality:
    """A fitted classifier. ``column`` gives the score of a text column: 0 to 1, higher for better text; null counts as empty."""

    def __init__(self, pooling: Pooling, network: Network):
        self.pooling, self.network = pooling, network

    def scores(self, texts: pa.Array) -> np.ndarray:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [self.network.score(self.pooling.pool(p.column("text"))) for p in words.slices(batch, "text")]
        return np.concatenate(parts) if parts else np.zeros(0)

    def column(self, text):
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(self.scores(texts), pa.float64())
        return F.arrow_udf(score, "double")(F.col(text).cast("string") if isinstance(text, str) else text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Quality:
    """Word vectors from all of ``docs`` (doc_id, text), the network from ``labels`` (doc_id and a 0/1 column).

    Unlabelled, null or held-out labels do not teach; without labels of both classes every score is their share (0.5 without
    any). Repeated rows count as often as they stand; empty tables are allowed; other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    pooling = Pooling(contexts(docs))
    sample = docs.join(F.broadcast(teaching(labels, label, most_rows)), "doc_id").select("y", "text")
    rows = sample.mapInArrow(pooling, "y int, vector array<double>").toArrow()
    x = np.array(rows.column("vector").to_pylist(), float).reshape(rows.num_rows, 2 * DIM + 1)
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the order of arrival must not change the fit
    return Quality(pooling, Network(x[order], y[order]))
