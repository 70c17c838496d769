"""Words and word shingles of whole Arrow string batches as 64-bit hashes, with numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, after A-Z have been lower-cased. As all of these are
ASCII, UTF-8 bytes can be scanned as they are. A word's hash is a polynomial of its bytes modulo 2**64, taken from
prefix sums over the whole batch and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
GOLD = np.uint64(0x9E3779B97F4A7C15)
GOLDS = np.arange(1 << 12, dtype=np.uint64) * GOLD
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x + GOLD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to at most ``most_bytes`` (or one row), so that work space is bounded."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(sizes)]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 places where they begin and end; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the n + 1 places in them where documents begin and end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    gap = SPACE[data]
    first = np.r_[True, gap[:-1]]
    first[at[:-1][at[:-1] < len(data)]] = True
    begin = np.flatnonzero(~gap & first)
    last = np.r_[gap[1:], True]
    last[at[1:][at[1:] > 0] - 1] = True
    end = np.flatnonzero(~gap & last) + 1
    return begin, end, np.searchsorted(begin, at)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] ^ (end - begin).astype(np.uint64) << np.uint64(48))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and the n + 1 places where documents begin and end."""
    data, at = text_bytes(texts)
    data = LOWER[data]
    begin, end, docs = word_bounds(data, at)
    return span_hashes(data, begin, end), docs


def shingles(words: np.ndarray, docs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words; a document of fewer words has its whole sequence as one, one without words none."""
    count = np.diff(docs)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_at = np.r_[0, np.cumsum(made)]
    start = np.arange(out_at[-1]) + np.repeat(docs[:-1] - out_at[:-1], made)
    length = np.minimum(np.repeat(count, made), k)
    acc = words[start].copy()
    for j in range(1, k):
        more = np.flatnonzero(length > j)
        acc[more] = mix(acc[more] * np.uint64(0xD6E8FEB86659FD93) + words[start[more] + j])
    return acc, out_at


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, one after another, and the n + 1 places that part them."""
    values, at = shingles(*word_hashes(texts), k)
    sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    return (np.concatenate(sets) if sets else values), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
