"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text compress each window of a document.

A window is one word (a run of letters, lower-cased) between blanks, followed by a fixed guard so that zstandard, which
does not look for matches in the last bytes of its input, can match all of the word. Each dictionary holds the windows of
its class, the commonest last; the toxic one only those that toxic documents have far oftener than ordinary ones (five times
the rate, and a chance below ALPHA by the exact hypergeometric tail, however rare the word), counted in documents after near
copies have been collapsed, since ordinary words would fill both. A window is a hit if it compresses to no more bytes with the
toxic dictionary than the longest of that dictionary's own windows does (far ones take more bytes than near ones), and to fewer, by a calibrated margin, than with the ordinary one.
The number of hits, their share of the words and their mean gain give a document's score through a calibrated logistic
network. Longer windows were tried: one such word in six or eight then changes the length less than chance does.

The dictionaries and the calibration use at most ``labelled.MOST_ROWS`` labelled documents outside the held-out part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm import words
from tabularium.llm.labelled import MOST_ROWS, Network, teaching

GUARD = np.zeros(8, np.uint8)
MOST_WINDOWS = 4096
SHORTEST = 3
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
MARGINS = (1, 2, 3)
#: One-sided chance of four standard errors.
ALPHA = math.erfc(4 / math.sqrt(2)) / 2


def word_spans(texts: pa.Array):
    """Lower-cased bytes, where words of at least SHORTEST bytes begin and end in them, and the n + 1 places of documents."""
    data, at = words.text_bytes(texts)
    data = words.LOWER[data]
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    letter = LETTER[data]
    first, last = np.r_[True, ~letter[:-1]], np.r_[~letter[1:], True]
    first[at[:-1][at[:-1] < len(data)]] = True
    last[at[1:][at[1:] > 0] - 1] = True
    begin, end = np.flatnonzero(letter & first), np.flatnonzero(letter & last) + 1
    long = end - begin >= SHORTEST
    begin, end = begin[long], end[long]
    return data, begin, end, np.searchsorted(begin, at)


def windows(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the given words one after another, and the n + 1 places that part them."""
    size = end - begin + 2 + len(GUARD)
    at = np.r_[0, np.cumsum(size)]
    out = np.zeros(at[-1], np.uint8)
    out[at[:-1]] = out[at[1:] - len(GUARD) - 1] = 32
    length = end - begin
    inner = np.repeat(at[:-1] + 1 - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
    out[inner] = data[np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
    return out, at


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=5, min_match=4, target_length=32,
                                              strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False,
                                              write_dict_id=False)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def lengths(how: zstandard.ZstdCompressor, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The compressed length of each window."""
    if len(at) < 2:
        return np.zeros(0, np.int64)
    segments = np.stack([at[:-1], np.diff(at)], axis=1).astype(np.uint64)
    done = how.multi_compress_to_buffer(zstandard.BufferWithSegments(data.tobytes(), segments.tobytes()))
    return np.fromiter((len(done[i]) for i in range(len(done))), np.int64, len(done))


def vocabulary(batches):
    """The distinct words of each document, with its label."""
    for batch in batches:
        for part in words.slices(batch, "text"):
            data, begin, end, docs = word_spans(part.column("text"))
            hashes = words.span_hashes(data, begin, end)
            raw = data.tobytes()
            for i, y in enumerate(part.column("y").to_pylist()):
                _, some = np.unique(hashes[docs[i]:docs[i + 1]], return_index=True)
                some += docs[i]
                out = [raw[a:b] for a, b in zip(begin[some], end[some])]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array([y] * len(out), pa.int32())], names=["word", "y"])


def leaders(batches):
    """Each row with the smallest shingle hash of its text, which near copies share."""
    for batch in batches:
        for part in words.slices(batch, "text", 1 << 18):
            values, at = words.shingle_sets(part.column("text"))
            values = words.mix(values)
            lead = [int(values[a:b].min().view(np.int64)) if b > a else 0 for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("text"), pa.array(lead, pa.int64())], names=["y", "text", "lead"])


class Distance:
    """The two dictionaries. ``features(margin)`` of texts: hits, their share of the words, and their mean gain."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self.content = [self.joined(ws[::-1]) for ws in (toxic, ordinary)]
        self.how = None
        own = np.frombuffer(self.content[0], np.uint8)
        at = np.r_[0, np.cumsum([len(w) + 2 + len(GUARD) for w in toxic[::-1]])].astype(np.int64)
        self.most = int(np.max(lengths(self.compressors()[0], own, at))) if toxic else -1
        self.how = None

    @staticmethod
    def joined(ws: list[bytes]) -> bytes:
        return b"".join(b" " + w + b" " + GUARD.tobytes() for w in ws) or b" " + GUARD.tobytes()

    def compressors(self):
        if self.how is None:
            self.how = [compressor(c) for c in self.content]
        return self.how

    def __getstate__(self):
        return self.__dict__ | {"how": None}

    def gains(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word the bytes that the toxic dictionary saves if it is matched as a whole, else 0; and the places of documents."""
        data, begin, end, docs = word_spans(texts)
        if not len(begin) or self.most < 0:
            return np.zeros(len(begin), np.int64), docs
        _, first, back = np.unique(words.span_hashes(data, begin, end), return_index=True, return_inverse=True)
        made, at = windows(data, begin[first], end[first])
        toxic, ordinary = (lengths(how, made, at) for how in self.compressors())
        return np.where(toxic <= self.most, np.maximum(ordinary - toxic, 0), 0)[back], docs

    def features(self, texts: pa.Array, margins=MARGINS) -> np.ndarray:
        gain, docs = self.gains(texts)
        total = lambda v: np.diff(np.r_[0, np.cumsum(v)][docs])
        out = []
        for margin in margins:
            hits, sums = total(gain >= margin), total(np.where(gain >= margin, gain, 0))
            out.append(np.stack([np.minimum(hits, 3), np.log1p(hits), hits / np.maximum(1, np.diff(docs)), sums / np.maximum(1, hits)], axis=1))
        return np.stack(out)

    def __call__(self, batches):
        for batch in batches:
            for part in words.slices(batch, "text", 1 << 21):
                x = self.features(part.column("text")).transpose(1, 0, 2).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "vector"])


class Toxicity:
    """A fitted scorer. ``column`` gives the score of a text column: 0 to 1, higher for toxic text; null counts as empty."""

    def __init__(self, distance: Distance, margin: int, network: Network):
        self.distance, self.margin, self.network = distance, margin, network

    def scores(self, texts: pa.Array) -> np.ndarray:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [self.network.score(self.distance.features(p.column("text"), (self.margin,))[0]) for p in words.slices(batch, "text", 1 << 21, 8192)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def column(self, text):
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(self.scores(texts), pa.float64())
        return F.arrow_udf(score, "double")(F.col(text).cast("string") if isinstance(text, str) else text)


def tails(bad: int, good: int):
    """For words found in b of ``bad`` and g of ``good`` documents, the chance of b or more by the hypergeometric law."""
    logs = np.r_[0, np.cumsum(np.log(np.arange(1, bad + good + 1)))]
    choose = lambda n, k: logs[n] - logs[k] - logs[n - k]

    def chance(b: pa.Array, g: pa.Array) -> pa.Array:
        pairs, back = np.unique(np.stack([b.to_numpy(), g.to_numpy()], axis=1), axis=0, return_inverse=True)
        out = []
        for x, y in pairs:
            k = np.arange(x, min(x + y, bad) + 1)
            k = k[x + y - k <= good]
            out.append(np.exp(choose(bad, k) + choose(good, x + y - k) - choose(bad + good, x + y)).sum())
        return pa.array(np.array(out, float)[back.ravel()])

    return F.arrow_udf(chance, "double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_ROWS) -> Toxicity:
    """Dictionaries and calibration from labelled documents (``docs``: doc_id, text; ``labels``: doc_id and a 0/1 column).

    Null labels, held-out and unlabelled documents do not teach. Without labels of both classes, or without words that set the
    toxic ones apart, every score is the share of toxic labels (0.5 without any label). Empty tables are allowed.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = docs.join(F.broadcast(teaching(labels, label, most_rows)), "doc_id").select("y", "text")
    apart = sample.mapInArrow(leaders, "y int, text string, lead long").groupBy("y", "lead").agg(F.min("text").alias("text"))
    rows = {r.y: r["n"] for r in apart.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = rows.get(1, 0), rows.get(0, 0)
    counts = (apart.select("y", "text").mapInArrow(vocabulary, "word binary, y int").groupBy("word")
              .agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")))
    p, q = F.col("bad") / max(bad, 1), F.col("good") / max(good, 1)
    top = lambda df, by: [bytes(r.word) for r in df.orderBy(F.desc(by), "word").limit(MOST_WINDOWS).collect()]
    toxic = top(counts.where((p > 5 * q) & (tails(bad, good)("bad", "good") < ALPHA)), "bad")
    distance = Distance(toxic, top(counts.where("good > 0"), "good"))
    made = sample.mapInArrow(distance, "y int, vector array<double>").toArrow()
    width = 4
    x = np.array(made.column("vector").to_pylist(), float).reshape(made.num_rows, len(MARGINS), width)
    y = made.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.reshape(len(x), len(MARGINS) * width).T, y))  # the order of arrival must not change the fit
    x, y = x[order], y[order]
    fits = [(m, Network(x[:, i], y, hidden=6)) for i, m in enumerate(MARGINS)]
    margin, network = min(fits, key=lambda f: np.mean((f[1].score(x[:, MARGINS.index(f[0])]) - y) ** 2) if len(y) else 0)
    return Toxicity(distance, margin, network)
