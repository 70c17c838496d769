"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

The pieces and scores of a model file make a unigram vocabulary; a text's ids are its best-scoring segmentation (of equal sums,
the one whose last piece is longest, and so on backwards). Files of the BPE kind carry scores too (minus the merge rank) and
are searched in the same way, so their ids need not be those of the merge procedure; decoding is the same.

Texts are normalised by the model's own rules and cut where no piece can cross: before a run of word marks and around characters
that no piece has. The distinct units of a slice are searched together, those of equal length as one matrix that
advances character by character: substring hashes probe the sorted hashes of the pieces, and the maximum over piece lengths
leaves a backpointer. Characters that no piece has become byte pieces, or the unknown id where the model has no bytes.
"""

from __future__ import annotations

import hashlib
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm import words

MARK = "▁"
CELLS = 1 << 18
STEP = np.uint64(0xD6E8FEB86659FD93)


class Vocabulary:
    """Pieces of a model file, ready for search."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        odd = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
        plain = [i for i in range(n) if not odd[i]]
        self.longest = max((len(names[i]) for i in plain), default=1)
        self.crossing = any(MARK in names[i].lstrip(MARK) for i in plain)
        keys = np.array([self.key(names[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int32)[order]
        self.scores = np.array([m.get_score(i) for i in plain])[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        #: Whether a hash's leading bits are those of any piece, so that few substrings need the binary search.
        self.leading = np.zeros(1 << 20, bool)
        self.leading[self.keys >> np.uint64(44)] = True
        self.known = np.zeros(sys.maxunicode + 1, bool)
        self.known[[ord(c) for i in plain for c in names[i]]] = True
        #: A single known character that is no piece costs more than any piece, as in the model's own search.
        self.least = min(self.scores, default=0.0) - 10.0
        bytes_ = {int(names[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.bytes = np.array([bytes_[b] for b in range(256)], np.int32) if len(bytes_) == 256 else None
        self.unknown = m.unk_id()
        self.text = [b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else bytes([int(names[i][1:-1], 16)]) if m.is_byte(i)
                     else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.prefix = m.normalize("a").startswith(MARK)

    @staticmethod
    def key(piece: str) -> int:
        acc = np.zeros(1, np.uint64)
        for c in piece:
            acc = words.mix(acc * STEP + np.uint64(ord(c)))
        return int(acc[0])

    def fallback(self, char: int) -> np.ndarray:
        """The ids of a character outside all pieces."""
        return np.array([self.unknown], np.int32) if self.bytes is None else self.bytes[list(chr(char).encode("utf-8", "replace"))]

    def search(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ids of the rows of a matrix of code points (units of equal length), one row after another, and their counts."""
        rows, length = chars.shape
        best = np.full((rows, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((rows, length + 1), np.int16), np.full((rows, length + 1), -1, np.int32)
        line = np.arange(rows)
        hashes = np.zeros((rows, min(self.longest, length)), np.uint64)  # of the substrings that end here, by length
        for end in range(1, length + 1):
            reach = min(end, self.longest)
            # substrings grow to the left: hashing runs over starts, each start's hash takes one more character
            hashes[:, 1:reach] = hashes[:, :reach - 1]
            hashes[:, 0] = 0
            hashes[:, :reach] = words.mix(hashes[:, :reach] * STEP + chars[:, end - 1:end].astype(np.uint64))
            probe = hashes[:, :reach]
            where = np.nonzero(self.leading[probe >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.keys, probe[where]), len(self.keys) - 1)
            hit = self.keys[at] == probe[where]
            row, size, at = where[0][hit], where[1][hit], at[hit]
            value, found = np.full((rows, reach), -np.inf), np.full((rows, reach), -1, np.int32)
            value[:, 0] = self.least
            value[row, size], found[row, size] = self.scores[at], self.ids[at]
            value += best[:, end - reach:end][:, ::-1]
            pick = reach - 1 - np.argmax(value[:, ::-1], axis=1)
            best[:, end], back[:, end], piece[:, end] = value[line, pick], pick + 1, found[line, pick]
        place, steps = np.full(rows, length), []
        while (place > 0).any():
            steps.append(np.where(place > 0, piece[line, place], -2))
            steps[-1][(place > 0) & (steps[-1] == -1)] = -3 - chars[line, place - 1][(place > 0) & (steps[-1] == -1)].astype(np.int64)
            place = place - np.where(place > 0, back[line, place], 0)
        path = np.stack(steps[::-1], axis=1)
        count = (path != -2).sum(axis=1)
        flat = path[path != -2]
        for row in np.flatnonzero((path < -2).any(axis=1))[::-1]:  # characters that no piece covers alone
            end = int(count[:row + 1].sum())
            begin = end - int(count[row])
            ids = np.concatenate([[x] if x >= 0 else self.fallback(-3 - x) for x in flat[begin:end]])
            flat, count[row] = np.concatenate([flat[:begin], ids, flat[end:]]), len(ids)
        return flat.astype(np.int32), count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [self.model.normalize(t) if t else "" for t in texts]
        code = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4")
        docs_at = np.cumsum([0, *map(len, plain)])
        if not len(code):
            return [np.zeros(0, np.int32) for _ in texts]
        known, mark = self.known[code], code == ord(MARK)
        cut = ~known | ~np.r_[False, known[:-1]]
        cut[docs_at[:-1][docs_at[:-1] < len(code)]] = True
        if not self.crossing:
            cut |= mark & ~np.r_[False, mark[:-1]]
        begin = np.flatnonzero(cut)
        end = np.r_[begin[1:], len(code)]
        _, some, which = np.unique(words.span_hashes(code, begin, end), return_index=True, return_inverse=True)
        first, size = begin[some], (end - begin)[some]
        order, flats, counts = [], [], []
        for length in np.unique(size):
            mine = np.flatnonzero(size == length)
            if length == 1:
                alone = self.known[code[first[mine]]]
                for i in mine[~alone]:
                    ids = self.fallback(int(code[first[i]]))
                    order, flats, counts = [*order, [i]], [*flats, ids], [*counts, [len(ids)]]
                mine = mine[alone]
            for part in np.array_split(mine, max(1, len(mine) * (int(length) + 1) // CELLS)):
                if len(part):
                    flat, count = self.search(code[first[part][:, None] + np.arange(length)])
                    order, flats, counts = [*order, part], [*flats, flat], [*counts, count]
        order, flat, count = np.concatenate(order), np.concatenate(flats), np.concatenate(counts)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, which = np.r_[0, np.cumsum(count)], place[which]
        count = (at[1:] - at[:-1])[which]
        ends = np.r_[0, np.cumsum(count)]
        ids = flat[np.repeat(at[:-1][which] - ends[:-1], count) + np.arange(ends[-1])]
        out = np.split(ids, ends[np.searchsorted(begin, docs_at[1:-1])])
        if self.bytes is None and len(ids):
            out = [x[~((x == self.unknown) & (np.r_[-1, x[:-1]] == self.unknown))] for x in out]  # a run of unknowns is one
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of ids: bytes are joined, word marks are spaces, the first of which the normaliser had added."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of a text column (null: no ids); all other columns stay."""
    def make(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([x for p in words.slices(batch, "text", 1 << 21, 1 << 13) for x in vocabulary(path).encode(p.column("text").to_pylist())], pa.list_(pa.int32()))
    return docs.withColumn(column, F.arrow_udf(make, "array<int>")(F.col(text).cast("string")))


def decoded(docs: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array column of piece ids (null: null); all other columns stay."""
    def make(rows: pa.Array) -> pa.Array:
        known = vocabulary(path)
        return pa.array([None if x is None else known.decode(x) for x in rows.to_pylist()], pa.string())
    return docs.withColumn(column, F.arrow_udf(make, "string")(F.col(ids)))


def digested(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_pieces, ids, decoded_sha256, round_trip`` for each row of ``docs`` (doc_id, text; others are not read).

    Null and empty texts have no ids and decode to the empty text. Rows that repeat are rows of their own; no rows give no
    rows. round_trip says that decoding gives the text again, which fails only where the model's normaliser changes it.
    """
    def make(batches):
        known = vocabulary(path)
        for batch in batches:
            for part in words.slices(batch, "text", 1 << 21, 1 << 13):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = known.encode(texts)
                back = [known.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
                     pa.array([a == b for a, b in zip(texts, back)], pa.bool_())], names=["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(make, "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean"))
