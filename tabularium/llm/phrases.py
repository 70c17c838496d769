"""Collocations of each language by best-first branch-and-bound growth.

A phrase of words w1 … wm that stands a times is cut in two everywhere; with n words in all and counts l and r of the two parts, its score is
the smallest floor(1000 a n / (l r)). As a is at most r, no phrase that begins with w1 can score more than floor(1000 n / f(w1)):
the count of a prefix bounds all that can grow out of it. So prefixes wait in a frontier ordered by this bound.

1. Words are counted. Those below ``least`` occurrences can be in no candidate, so a second scan of the texts writes the runs of
   the others, as 64-bit hashes of language and word, and which words these are. All further scans read the runs.
2. The frontier is expanded in bands of falling bounds, each band some share of all occurrences. A scan counts, for all prefixes
   under expansion at once, every extension by one word to the right. Extensions that stand often enough are prefixes for the next
   scan. Extensions to the left, and the parts that cuts need, are counted along the way.
3. When a band is used up, everything in it is settled: all counts of its cuts are known, and so is whether a longer candidate stands
   as often (then so does one that is longer by one word, on the left or on the right). The score of the ``top``-th survivor of a
   language closes every first word whose bound is below it. A language is done when no open word is left; ties at the
   bound stay open.

Phrases are known by 64-bit hashes until the end. The sets that steer a scan are bitmaps of bounded size, whose false hits cost
work and change no count. Counts leave tasks as sorted runs dealt by hash, one number per phrase and run, so that no phrase
is hot however often it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.llm import words
from tabularium.llm.store import drop, kept, partitions

LEAST, TOP, LONGEST = 100, 2000, 5
#: Shares of all occurrences of frequent words that first words of a band come to, bands taken together.
BANDS = (1 / 16, 1 / 4, 1)
#: Bits of a set that steers a scan, as a power of two: at least, at most (16 MB), and beyond the number of frequent words.
LEAST_BITS, MOST_BITS, MORE_BITS = 16, 27, 5
#: Counts that a task holds before it passes them on, and bytes of text scanned at once.
HELD, SLICE = 1 << 17, 1 << 18
#: Hashes in one row of written runs, where a run ends; rows are small, and many of them are scanned at once.
ROW, ROWS_AT_ONCE = 1 << 10, 128
#: Bytes of text whose counts come together in one group.
GROUP_BYTES = 1 << 27
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09]] = True
# The characters that end a piece.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
TURN = np.uint64(0xD6E8FEB86659FD93)
EXPAND, COUNT = range(2)
SALTS = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)]
FOUND = "right boolean, hash long, a long, codes array<long>, left array<long>, rest array<long>"
LONGS = pa.list_(pa.int64())


def seed(lang: str) -> int:
    """A language's 64-bit hash."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def places(hashes: np.ndarray, kind: int, size: int) -> np.ndarray:
    """Where hashes lie in the bitmap of a kind with 2**size bits."""
    return (words.mix(hashes ^ SALTS[kind]) >> np.uint64(64 - size)).astype(np.int64)


def holds(bits: list[np.ndarray], hashes: np.ndarray, kind: int) -> np.ndarray:
    if not len(bits[kind]):
        return np.zeros(len(hashes), bool)
    at = places(hashes, kind, (8 * len(bits[kind])).bit_length() - 1)
    return (bits[kind][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def extended(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases with one more word."""
    return words.mix(phrase * TURN + word)


class Words:
    """The words of some texts: where they are, their hashes with the language's, and the pieces they stand in."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        data, at = words.text_bytes(texts)
        self.data, self.langs = words.LOWER[data], langs
        stop = BREAK[self.data]
        inside = ~(stop | SPACE[self.data])
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        starts, ends = at[:-1][at[:-1] < at[1:]], at[1:][at[1:] > at[:-1]] - 1
        first[starts], last[ends] = inside[starts], inside[ends]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(at, self.begin, side="right") - 1
        # the stops so far and the text's number name the piece
        self.piece = np.searchsorted(np.flatnonzero(stop), self.begin) + self.doc
        seeds = {x: seed(x) for x in set(langs)}
        if len(self.begin):
            self.one = words.mix(words.span_hashes(self.data, self.begin, self.end) ^ np.array([seeds[x] for x in langs], np.uint64)[self.doc])
            self.one[self.one == 0] = 1  # 0 parts runs
        else:
            self.one = np.zeros(0, np.uint64)

    def word(self, i: int) -> str:
        return self.data[self.begin[i]:self.end[i]].tobytes().decode()


def merged(runs: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by hash, in ascending order of hashes."""
    hashes, counts = np.concatenate([h for h, _ in runs]), np.concatenate([c for _, c in runs]).astype(np.int64)
    by = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[by], counts[by]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[first], np.add.reduceat(counts, first)


def collapsed(exact: np.ndarray) -> np.ndarray:
    """Rows of hash, count and word hashes with one row per hash."""
    exact = exact[np.argsort(exact[:, 0], kind="stable")]
    first = np.flatnonzero(np.r_[True, exact[1:, 0] != exact[:-1, 0]])
    out = exact[first]
    out[:, 1] = np.add.reduceat(exact[:, 1], first)
    return out


class Held:
    """Counts that a task has not passed on yet: by hash alone, and of phrases with their words."""

    def __init__(self, buckets: int):
        self.buckets, self.runs, self.exact, self.size = buckets, {True: [], False: []}, [], 0

    def add(self, hashes: np.ndarray, right: bool) -> None:
        if len(hashes):
            self.runs[right].append(np.unique(hashes, return_counts=True))
            self.size += len(self.runs[right][-1][0])

    def add_exact(self, hashes: np.ndarray, at: np.ndarray, code: np.ndarray, m: int, longest: int) -> None:
        some, first, n = np.unique(hashes, return_index=True, return_counts=True)
        rows = np.zeros((len(some), longest + 2), np.uint64)
        rows[:, 0], rows[:, 1] = some, n
        rows[:, 2:2 + m] = code[at[first][:, None] + np.arange(m)]
        self.exact.append(rows)
        self.size += rows.size // 2

    def bucket(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of sorted hashes, and where its number changes."""
        bucket = (hashes >> np.uint64(32)).astype(np.int64) * self.buckets >> 32
        return bucket, np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = []
        for right, runs in self.runs.items():
            if runs:
                hashes, counts = merged(runs)
                bucket, cuts = self.bucket(hashes)
                rows += [(int(bucket[a]), right, hashes[a:b].tobytes(), counts[a:b].tobytes(), None) for a, b in zip(cuts[:-1], cuts[1:])]
        if self.exact:
            exact = collapsed(np.concatenate(self.exact))
            bucket, cuts = self.bucket(exact[:, 0])
            rows += [(int(bucket[a]), None, None, None, exact[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        self.runs, self.exact, self.size = {True: [], False: []}, [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))],
                                             names=["bucket", "right", "hashes", "counts", "exact"])


COUNTS = "bucket int, right boolean, hashes binary, counts binary, exact binary"


def count_words(buckets: int):
    """All words of the texts, counted by hash."""
    def make(batches):
        held = Held(buckets)
        for batch in batches:
            for rows in words.slices(batch, "text", SLICE, 4096):
                held.add(Words(rows.column("text"), rows.column("lang").to_pylist()).one, True)
                if held.size >= HELD:
                    yield from held.flush()
        yield from held.flush()
    return make


def write_runs(bits, buckets: int):
    """Runs of two and more frequent words with 0 between them, and the frequent words themselves by bucket, lists in step."""
    def make(batches):
        sets, seen, total = [np.frombuffer(b, np.uint8) for b in bits.value], {}, {}

        def known():
            by_bucket = {}
            for lang, n in total.items():
                seen[seed(lang)] = (lang, None)
            for h, (lang, word) in seen.items():
                by_bucket.setdefault((h >> 32) * buckets >> 32, []).append((h - (h >> 63 << 64), lang, word, total[lang] if word is None else 0))
            seen.clear()
            total.clear()
            if by_bucket:
                columns = [pa.nulls(len(by_bucket), pa.binary()), pa.array(list(by_bucket), pa.int32())]
                for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64())):
                    columns.append(pa.array([[r[i] for r in rows] for rows in by_bucket.values()], pa.list_(kind)))
                yield pa.RecordBatch.from_arrays(columns, names=["codes", "bucket", "hash", "lang", "word", "n"])

        for batch in batches:
            for rows in words.slices(batch, "text", SLICE, 4096):
                langs = rows.column("lang").to_pylist()
                found = Words(rows.column("text"), langs)
                for lang, n in zip(langs, np.bincount(found.doc, minlength=len(langs)).tolist()):
                    total[lang] = total.get(lang, 0) + n
                at = np.flatnonzero(holds(sets, found.one, COUNT))
                some, first = np.unique(found.one[at], return_index=True)
                for h, i in zip(some.tolist(), at[first].tolist()):
                    if h not in seen:
                        seen[h] = (found.langs[found.doc[i]], found.word(i))
                joined = (np.diff(at) == 1) & (np.diff(found.piece[at]) == 0)
                stay = np.r_[False, joined] | np.r_[joined, False] if len(at) else np.zeros(0, bool)
                fresh = (~np.r_[False, joined])[stay] if len(at) else stay
                codes = np.insert(found.one[at[stay]], np.flatnonzero(fresh), 0)
                if len(codes):
                    zeros = np.flatnonzero(codes == 0)  # each run begins with one
                    cuts = np.unique(zeros[np.searchsorted(zeros, np.arange(0, zeros[-1] + 1, ROW))]).tolist()
                    blobs = [codes[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(codes)])]
                    yield pa.RecordBatch.from_arrays([pa.array(blobs), *(pa.nulls(len(blobs), k) for k in (pa.int32(), LONGS, pa.list_(pa.string()), pa.list_(pa.string()), LONGS))],
                                                     names=["codes", "bucket", "hash", "lang", "word", "n"])
                if len(seen) >= HELD // 2:
                    yield from known()
        yield from known()
    return make


def name_words(table: pa.Table) -> pa.Table:
    """One row per word of a bucket; languages' totals as words without a name."""
    flat = pa.table({c: table.column(c).combine_chunks().flatten() for c in ("hash", "lang", "word", "n")})
    return flat.group_by(["hash", "lang", "word"]).aggregate([("n", "sum")]).rename_columns(["hash", "lang", "word", "n"])


def scan(bits, buckets: int, longest: int, m: int):
    """Extensions to m + 1 words of expanded phrases of m words, and exact counts of phrases of up to m words as the bitmaps ask."""
    def make(batches):
        sets, held = [np.frombuffer(b, np.uint8) for b in bits.value], Held(buckets)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                code = np.frombuffer(b"".join(batch.column("codes").slice(first, ROWS_AT_ONCE).to_pylist()), np.uint64)
                n, chain, before = len(code), np.flatnonzero(code), code
                for size in range(2, min(m + 1, longest) + 1):
                    chain = chain[chain + size - 1 < n]
                    chain = chain[code[chain + size - 1] != 0]
                    h = extended(before[chain], code[chain + size - 1])
                    if size <= m:
                        exact = holds(sets, h, COUNT)
                        if exact.any():
                            held.add_exact(h[exact], chain[exact], code, size, longest)
                    else:
                        right = holds(sets, before[chain], EXPAND)
                        held.add(h[right], True)
                        if m > 1:
                            held.add(h[holds(sets, before[chain + 1], EXPAND) & ~right], False)
                    before = np.zeros(n, np.uint64)
                    before[chain] = h
                if held.size >= HELD:
                    yield from held.flush()
        yield from held.flush()
    return make


def add_up(least: int, longest: int):
    """Sums of one bucket: hashes that stand often enough, and phrases with the hashes of their words and of the parts of all cuts."""
    def add(table: pa.Table) -> pa.Table:
        out = []
        for right in (True, False):
            part = table.filter(pc.equal(table.column("right"), right))
            runs = [(np.frombuffer(h.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int64)) for h, c in zip(part.column("hashes"), part.column("counts"))]
            if runs:
                hashes, counts = merged(runs)
                some = counts >= least
                size = int(some.sum())
                out.append(rows(pa.array([right] * size, pa.bool_()), hashes[some], counts[some], *[pa.nulls(size, LONGS)] * 3))
        exact = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, longest + 2) for x in table.column("exact") if x.is_valid]
        if exact:
            exact = collapsed(np.concatenate(exact))
            exact = exact[exact[:, 1] >= np.uint64(least)]
            length = (exact[:, 2:] != 0).sum(axis=1)
            for m in np.unique(length).tolist():
                some = exact[length == m]
                code = some[:, 2:2 + m]
                whole = {i: grown(code[:, i:]) for i in range(m)}  # whole[i][k]: the phrase of k + 1 words from i on
                left = np.stack([whole[0][k - 1] for k in range(1, m)], axis=1)
                rest = np.stack([whole[k][m - k - 1] for k in range(1, m)], axis=1)
                out.append(rows(pa.nulls(len(some), pa.bool_()), some[:, 0], some[:, 1].astype(np.int64), lists(code), lists(left), lists(rest)))
        return pa.concat_tables(out) if out else rows(pa.nulls(0, pa.bool_()), np.zeros(0, np.uint64), np.zeros(0, np.int64), *[pa.nulls(0, LONGS)] * 3)
    return add


def grown(code: np.ndarray) -> list[np.ndarray]:
    out = [code[:, 0]]
    for k in range(1, code.shape[1]):
        out.append(extended(out[-1], code[:, k]))
    return out


def lists(matrix: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(matrix).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(flat))


def rows(right, hashes, counts, *arrays) -> pa.Table:
    columns = [right, pa.array(np.ascontiguousarray(hashes).view(np.int64)), pa.array(counts), *arrays]
    return pa.table(columns, names=["right", "hash", "a", "codes", "left", "rest"])


def marks(size: int):
    """The places in the bitmaps for rows of a kind and a hash."""
    def make(batches):
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.zeros(len(kind), np.int64)
            for k in np.unique(kind).tolist():
                at[kind == k] = places(hashes[kind == k], k, size)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(at)], names=["kind", "at"])
    return make


def bitmaps(items: DataFrame, n: int) -> list[bytes]:
    """The bitmaps of ``items`` (kind, hash), sized by ``n`` up to a limit; empty for a kind without items."""
    size = min(MOST_BITS, max(LEAST_BITS, n.bit_length() + MORE_BITS))
    spread = items.mapInArrow(marks(size), "kind int, at long")
    found = (spread.groupBy("kind", F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow())
    out = []
    for kind in (EXPAND, COUNT):
        part = found.filter(pc.equal(found.column("kind"), kind))
        bits = np.zeros(1 << size - 6, np.int64)
        bits[part.column("word").to_numpy()] = part.column("bits").to_numpy()
        out.append(bits.astype("<i8").tobytes() if part.num_rows else b"")
    return out


class Growth:
    """Counts known so far, and the scans that add to them."""

    def __init__(self, docs: DataFrame, least: int, longest: int):
        self.spark, self.least, self.longest = docs.sparkSession, least, longest
        self.written: list[DataFrame] = []
        lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
        texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.buckets = max(partitions(self.spark), -(-size // GROUP_BYTES))
        counted = self.keep(texts.mapInArrow(count_words(self.buckets), COUNTS).groupBy("bucket").applyInArrow(add_up(least, longest), FOUND), "counts")
        self.n = counted.count()
        bits = self.spark.sparkContext.broadcast(bitmaps(counted.select(F.lit(COUNT).alias("kind"), "hash"), self.n))
        made = self.keep(texts.mapInArrow(write_runs(bits, self.buckets), "codes binary, bucket int, hash array<long>, lang array<string>, word array<string>, n array<long>"), "runs")
        bits.destroy()
        self.runs = made.where("codes IS NOT NULL").select("codes")
        named = self.keep(made.where("bucket IS NOT NULL").drop("codes").groupBy("bucket").applyInArrow(name_words, "hash long, lang string, word string, n long"), "words")
        self.totals = named.where("word IS NULL").select("lang", F.col("n").alias("total"))
        self.words = self.keep(named.where("word IS NOT NULL").join(counted.select("hash", "a"), "hash").select("hash", "lang", "word", "a"), "words")
        self.phrases = None

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.written.append(kept(df, label))
        return self.written[-1]

    def grow(self, band: DataFrame) -> None:
        """Expands the words of ``band`` (their hashes) until nothing grows out of them any more."""
        items, m = band.select(F.lit(EXPAND).alias("kind"), "hash"), 1
        while True:
            made = bitmaps(items, self.n)
            if not any(made):
                return
            bits = self.spark.sparkContext.broadcast(made)
            wave = self.keep(self.runs.mapInArrow(scan(bits, self.buckets, self.longest, m), COUNTS)
                             .groupBy("bucket").applyInArrow(add_up(self.least, self.longest), FOUND), "counts")
            bits.destroy()
            exact = wave.where("codes IS NOT NULL").select("hash", "a", "codes", "left", "rest")
            self.phrases = exact if self.phrases is None else self.phrases.unionByName(exact)
            # shorter phrases were asked for as parts of one whose parts were all asked for
            parts = exact.where(F.size("codes") == m).select(F.explode(F.expr("slice(rest, 1, size(rest) - 1)")).alias("hash"))
            by_hash = wave.where("codes IS NULL")
            items = by_hash.unionByName(parts, allowMissingColumns=True).select(F.lit(COUNT).alias("kind"), "hash")
            if m + 1 < self.longest:
                items = items.unionByName(by_hash.where("right").select(F.lit(EXPAND).alias("kind"), "hash"))
            m = min(m + 1, self.longest)

    def survivors(self, used: DataFrame) -> DataFrame:
        """``lang, codes, a, l, r, n, score`` of candidates that begin with one of the ``used`` words (hash, lang) and that none dominates."""
        if self.phrases is None:
            return used.limit(0).selectExpr("lang", "array(hash) AS codes", *(f"hash AS {c}" for c in ("a", "l", "r", "n", "score")))
        known = self.keep(self.phrases.dropDuplicates(["hash"]), "phrases")
        long = known.where("size(codes) > 2")
        beaten = long.select(F.element_at("left", -1).alias("hash"), "a").unionByName(long.select(F.element_at("rest", 1).alias("hash"), "a")).distinct()
        alive = (known.join(beaten, ["hash", "a"], "left_anti").withColumn("first", F.element_at("codes", 1))
                 .join(used.select(F.col("hash").alias("first"), "lang"), "first"))
        cuts = alive.select("lang", "hash", "codes", "a", F.posexplode(F.arrays_zip("left", "rest")).alias("k", "cut"))
        counts = self.words.select("hash", "a").unionByName(known.select("hash", "a"))
        big = "CAST({} AS DECIMAL(19, 0))"
        score = F.expr(f"(1000 * {big.format('a')} * {big.format('n')}) div ({big.format('l')} * {big.format('r')})")
        scored = (cuts.select("lang", "hash", "codes", "a", "k", "cut.left", "cut.rest").join(counts.toDF("left", "l"), "left").join(counts.toDF("rest", "r"), "rest")
                  .join(self.totals.toDF("lang", "n"), "lang").withColumn("score", score))
        lowest = scored.groupBy("lang", "hash", "codes", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        return lowest.select("lang", "codes", "a", "cut.l", "cut.r", "n", "cut.score")

    def named(self, found: DataFrame) -> DataFrame:
        """``found`` with its phrases in words."""
        word = self.words.select(F.col("hash").alias("code"), "word")
        spelt = (found.withColumn("id", F.monotonically_increasing_id()).select("id", F.posexplode("codes").alias("i", "code")).join(word, "code")
                 .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w")))
        return found.withColumn("id", F.monotonically_increasing_id()).join(spelt, "id").withColumn("phrase", F.concat_ws(" ", F.col("w.word")))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, bands: tuple = BANDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two to ``longest`` words.

    Null texts are empty, a null lang is "und"; other columns than text and lang are not read. Repeated rows count each time. Ties go to the
    larger count, then to the smaller phrase by bytes, and among cuts to the first. No words give no rows.
    """
    growth = Growth(docs, least, longest)
    # words by falling bound: by eighths of an octave of their counts, a small table per language
    step = F.floor(F.log2(F.col("a")) * 8).cast("int")
    single = growth.words.join(growth.totals, "lang").select("lang", "hash", "a", step.alias("step"), F.expr("1000 * CAST(total AS DECIMAL(19, 0)) div a").alias("bound"))
    mass = single.groupBy("lang", "step").agg(F.sum("a").alias("mass"))
    order = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("mass").over(order) / F.sum("mass").over(Window.partitionBy("lang")), F.lit(0.0))
    opened = growth.keep(single.join(mass.select("lang", "step", share.alias("before")), ["lang", "step"]).withColumn("used", F.lit(False)), "frontier")
    by_lang = Window.partitionBy("lang")
    found = None
    for upto in bands:
        wanted = opened.withColumn("now", ~F.col("used") & (F.col("before") < upto))
        if found is not None:
            limit = (found.withColumn("place", F.row_number().over(by_lang.orderBy(F.desc("score")))).where(F.col("place") == top)
                     .select("lang", F.col("score").alias("limit")))
            wanted = wanted.join(limit, "lang", "left").withColumn("now", F.expr("now AND bound >= coalesce(limit, 0)")).drop("limit")
        opened = growth.keep(wanted.withColumn("used", F.col("used") | F.col("now")), "frontier")
        growth.grow(opened.where("now"))
        near = growth.survivors(opened.where("used")).withColumn("place", F.rank().over(by_lang.orderBy(F.desc("score"), F.desc("a"))))
        found = growth.keep(near.where(F.col("place") <= top).drop("place"), "survivors")
    place = F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = growth.named(found).withColumn("rank", place).where(F.col("rank") <= top)
    out = kept(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score"))), "collocations")
    drop(*growth.written)
    return out
