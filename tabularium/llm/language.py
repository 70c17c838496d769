"""Language ID by mixture inference: each document's language shares by expectation-maximisation over its words.

A language is a distribution over hashed letter n-grams (1 to 4 letters, with word ends), learned from all labelled documents
outside the held-out part. A word's likelihood under a language is the product over its n-grams of the longest
order's probability, interpolated with the shorter ones. A document is a mixture: EM estimates the languages' shares from its
words' likelihoods. Languages are then chosen by penalised likelihood: starting from the best one, the language that raises the
likelihood most is added as long as it gains more than ``PENALTY`` times the logarithm of the word count, and the
shares are estimated within the chosen set. The prediction is the language with the largest share.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm import words
from tabularium.llm.labelled import held_out

FOLDS, HELD = 4, 2
ORDERS, BUCKETS, BLOCK = (1, 2, 3, 4), 1 << 15, 1 << 12
ROUNDS, PENALTY = 12, 2.0
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def word_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters in lower case): for the distinct ones their hashed n-grams (orders, letters) ending at each letter
    or word end and the places where words begin among them; which distinct word each word is; and the n + 1 places where
    documents begin among the words."""
    low = [t.lower() if t else "" for t in texts.to_pylist()]
    code = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[code]
    begin = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    end = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
    docs = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in low)]))
    _, some, which = np.unique(words.span_hashes(code, begin, end), return_index=True, return_inverse=True)
    size = end[some] - begin[some] + 1
    at = np.r_[0, np.cumsum(size)].astype(np.int64)
    depth = np.arange(at[-1]) - np.repeat(at[:-1], size)
    unit = code[np.repeat(begin[some], size) + depth].astype(np.uint64)
    unit[at[1:] - 1] = 32
    out, acc = np.zeros((len(ORDERS), len(unit)), np.int64), np.zeros(len(unit), np.uint64)
    for n in ORDERS:
        back = np.full(len(unit), np.uint64(32))
        back[n - 1:] = unit[:len(unit) - n + 1]
        back[depth < n - 1] = 32
        acc = words.mix(acc * np.uint64(0xD6E8FEB86659FD93) + back)
        out[n - 1] = acc % np.uint64(BUCKETS)
    return out, at[:-1], which, docs


def counted(names: list[str]):
    """One row per language and block of n-gram buckets: a task's counts."""
    index = {name: i for i, name in enumerate(names)}

    def make(batches):
        total = np.zeros((len(names), len(ORDERS), BUCKETS))
        for batch in batches:
            for part in words.slices(batch, "text"):
                hashed, begin, which, docs = word_grams(part.column("text"))
                lang = np.repeat([index[x] for x in part.column("lang").to_pylist()], np.diff(docs))
                size = np.diff(np.r_[begin, hashed.shape[1]])
                for i in np.unique(lang):
                    often = np.repeat(np.bincount(which[lang == i], minlength=len(begin)), size)
                    for o in range(len(ORDERS)):
                        total[i, o] += np.bincount(hashed[o], often, BUCKETS)
        for i in range(len(names)):
            for b in range(0, BUCKETS, BLOCK):
                if total[i, :, b:b + BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([b], pa.int32()), pa.array([total[i, :, b:b + BLOCK].astype(np.int64).tobytes()])],
                                                     names=["lang", "block", "counts"])
    return make


def add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
    return pa.table({"lang": table.column("lang").slice(0, 1), "block": table.column("block").slice(0, 1), "counts": [total.tobytes()]})


class Languages:
    """Learned languages. ``infer`` gives each text's shares; ``column`` a struct column of the prediction.

    Texts without letters (or null) are ``und`` with score 0; without any learned language so are all texts."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth, self.logs = 1.0 / BUCKETS, None
        if names:
            for o in range(len(ORDERS)):
                size = counts[:, o].sum(axis=1, keepdims=True)
                # interpolation: as many pseudo-counts as there are distinct n-grams fall back on the mean over languages
                kinds = (counts[:, o] > 0).sum(axis=1, keepdims=True) + 1.0
                base = (counts[:, o].sum(axis=0) + 1.0) / (counts[:, o].sum() + BUCKETS)
                part = (counts[:, o] + kinds * (0.9 * base + 0.1 * smooth)) / (size + kinds)
                part = np.log(part) / len(ORDERS)
                self.logs = [part] if self.logs is None else [*self.logs, part]
            self.logs = np.ascontiguousarray(np.stack(self.logs).transpose(0, 2, 1)).astype(np.float32)

    def infer(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language shares (n, languages), all zero where there is no letter, and the number of words."""
        hashed, begin, which, docs = word_grams(texts)
        n, k = len(docs) - 1, len(self.names)
        shares, count = np.zeros((n, k)), np.diff(docs)
        if not k or not len(begin):
            return shares, count
        logs = np.zeros((hashed.shape[1], k), np.float32)
        for o in range(len(ORDERS)):
            logs += self.logs[o][hashed[o]]
        logs = np.add.reduceat(logs, begin, axis=0).astype(np.float64)
        logs = np.maximum(logs - logs.max(axis=1, keepdims=True), -60.0)
        like = np.exp(logs).T[:, which]
        some = np.flatnonzero(count)
        size = count[some]

        def estimate(open_: np.ndarray, chosen: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            """Shares within the chosen languages, and the log likelihood, of the documents that are open."""
            mine = like[:, np.repeat(open_, size)] if not open_.all() else like
            times = size[open_]
            at = np.r_[0, np.cumsum(times)[:-1]]
            pi = (chosen / chosen.sum(axis=1, keepdims=True)).T
            for step in range(rounds + 1):
                mixed = sum(row * np.repeat(share, times) for row, share in zip(mine, pi))
                if step < rounds:
                    pi = np.stack([share * np.add.reduceat(row / mixed, at) for row, share in zip(mine, pi)]) / times
            return pi.T, np.add.reduceat(np.log(mixed), at)

        alone = np.stack([np.add.reduceat(row[which], docs[:-1][some]) for row in logs.T], axis=1)
        best = np.zeros((len(some), k))
        best[np.arange(len(some)), alone.argmax(axis=1)] = 1
        chosen, score, least = best > 0, alone.max(axis=1), PENALTY * np.log(size + 1)
        everyone = np.ones(len(some), bool)
        full, most = estimate(everyone, np.ones((len(some), k)), ROUNDS)
        open_ = (most - score > least) & (k > 1)  # no smaller set can gain more than the full one
        while open_.any():
            rest = np.where(chosen, -1.0, full)
            trial = chosen.copy()
            trial[np.arange(len(some)), rest.argmax(axis=1)] = True
            pi, value = estimate(open_, trial[open_].astype(float), ROUNDS)
            more = np.zeros(len(some), bool)
            more[open_] = value - score[open_] > least[open_]
            best[more], score[more], chosen[more] = pi[more[open_]], value[more[open_]], trial[more]
            open_ = more & ~chosen.all(axis=1)
        shares[some] = best
        return shares, count

    def column(self, text):
        """A struct of lang, score (its share times how clearly it is ahead), languages and shares."""
        def predict(texts: pa.Array) -> pa.Array:
            out = []
            for part in words.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 19):
                shares, count = self.infer(part.column("text"))
                for x, c in zip(shares, count):
                    order = [i for i in np.argsort(-x, kind="stable") if x[i] > 0]
                    out.append({"lang": self.names[order[0]] if order else UNKNOWN, "score": float(min(1.0, x[order[0]])) if order else 0.0,
                                "languages": [self.names[i] for i in order], "shares": [float(x[i]) for i in order]})
            return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))]))
        return F.arrow_udf(predict, "lang string, score double, languages array<string>, shares array<double>")(
            F.col(text).cast("string") if isinstance(text, str) else text)


def fit(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> Languages:
    """Languages from all rows of ``docs`` (doc_id, text, lang) with a lang and outside the held-out part; null texts and ids do
    not teach, repeated rows count as they stand, and an empty table teaches no language. Other columns are not read."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", folds, held)).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    counts = np.zeros((len(names), len(ORDERS), BUCKETS))
    if names:
        sums = (rows.mapInArrow(counted(names), "lang int, block int, counts binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
                .groupBy("lang", "block", "salt").applyInArrow(add, "lang int, block int, counts binary")
                .groupBy("lang", "block").applyInArrow(add, "lang int, block int, counts binary"))
        for r in sums.collect():
            counts[r.lang, :, r.block:r.block + BLOCK] = np.frombuffer(r["counts"], np.int64).reshape(len(ORDERS), BLOCK)
    return Languages(names, counts)
