"""Token ids of whole texts, equal to those of the tokenizers library, by distinct pieces with a bounded cache.

A byte-level BPE vocabulary cuts a text into pieces by one pattern and merges inside pieces only. The pieces of many texts are
found with numpy at once and looked up by a 64-bit hash; only those not met before are merged, each once,
by tokenizers itself or, where ids rank the merges, by tiktoken. Texts with special tokens or rare characters, and other
kinds of vocabulary, are encoded by tokenizers as a whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from tabularium.llm import words

# Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these characters the libraries' Unicode tables may differ, so such texts go the slower way.
COMMON = "\x00-ɏ‐-‧€"
RARE = re.compile(f"[^{COMMON}]")
#: Pieces and ids in the cache, and the longest piece that it takes.
MOST_PIECES, MOST_IDS, LONGEST_PIECE = 1 << 19, 1 << 22, 48
SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each common character by the pattern's Unicode classes."""
    out = np.full(0x20ad, OTHER, np.uint8)
    for kind, which in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[[i for i in range(len(out)) if regex.match(which, chr(i))]] = kind
    return out


def piece_starts(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where PATTERN's pieces begin in texts of common characters, given as code points one after another.

    Runs of one kind are pieces. A run takes the space before it; any other white space before it stands alone, and what is
    left of the white space is a piece. A single apostrophe without a space before it takes s, t, m, d, re, ve or ll.
    """
    kind = kinds()[points]
    fresh = np.zeros(len(points) + 1, bool)
    fresh[np.r_[0, np.cumsum(sizes)]] = True
    start = fresh[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    after = runs[(kind[runs] != SPACE) & ~fresh[runs]]
    after = after[kind[after - 1] == SPACE]
    mark = np.flatnonzero((points == 0x27) & start)
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    mark = mark[~fresh[mark + 1] & start[mark]]  # an apostrophe with a space before it is no start any more
    one = points[mark + 1]
    second = mark + 2 < len(points)
    two = np.where(second, points[np.minimum(mark + 2, len(points) - 1)], 0)
    two[second] *= ~fresh[mark[second] + 2]
    size = np.where(np.isin(one, [*map(ord, "stmd")]), 2, 0)
    for pair in ("re", "ve", "ll"):
        size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 3
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    rest = (mark + size)[mark + size < len(points)]
    start[rest[(kind[rest] == LETTER) & ~fresh[rest]]] = True
    return np.flatnonzero(start)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class Pieces:
    """Ids of pieces met before, by the pieces' 64-bit hashes: an open table, probed for many at once, that starts anew when it is full."""

    def __init__(self, merge, width):
        self.merge, self.width, self.most = merge, width, MOST_PIECES
        self.clear()

    def clear(self) -> None:
        """Piece 0 stands for those not met; it has no ids."""
        self.slot = np.zeros(4 * self.most, np.int32)
        self.hash, self.at, self.ids = np.zeros(1, np.uint64), np.zeros(2, np.int64), np.zeros(0, self.width)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, 0 for those not met."""
        place = (hashes % np.uint64(len(self.slot))).astype(np.int64)
        number = self.slot[place]
        other = np.flatnonzero((self.hash[number] != hashes) & (number > 0))
        while len(other):
            place[other] = (place[other] + 1) % len(self.slot)
            number[other] = self.slot[place[other]]
            other = other[(self.hash[number[other]] != hashes[other]) & (number[other] > 0)]
        return number

    def put(self, numbers: np.ndarray) -> None:
        """Enters pieces into the table; where several want one place, the others go on to the next."""
        place = (self.hash[numbers] % np.uint64(len(self.slot))).astype(np.int64)
        while len(numbers):
            free = self.slot[place] == 0
            self.slot[place[free]] = numbers[free]
            left = self.slot[place] != numbers
            numbers, place = numbers[left], (place[left] + 1) % len(self.slot)

    def all(self, whole: str, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these pieces of a text, one after another, and the n + 1 places that part them."""
        number = self.known(hashes)
        new = np.flatnonzero(number == 0)
        if len(new):
            _, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            one, n = new[first], len(self.hash)
            if n > 1 and (n + len(one) > self.most or len(self.ids) > MOST_IDS):
                self.clear()
                return self.all(whole, begin, end, hashes)
            found = self.merge([whole[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist())])
            sizes = np.array([len(x) for x in found]) // np.dtype(self.width).itemsize
            self.hash, self.ids = np.r_[self.hash, hashes[one]], np.r_[self.ids, np.frombuffer(b"".join(found), self.width)]
            self.at = np.r_[self.at, self.at[-1] + np.cumsum(sizes)]
            number[new] = n + which
            self.put(n + np.flatnonzero((end - begin)[one] <= LONGEST_PIECE)[:self.most])
        count = self.at[number + 1] - self.at[number]
        to = np.r_[0, np.cumsum(count)]
        return self.ids[np.repeat(self.at[number] - to[:-1], count) + np.arange(to[-1])], to


def by_model(model, code: str):
    """Merges pieces by tokenizers' own model."""
    letters = byte_letters()

    def merge(pieces: list[str]) -> list[bytes]:
        return [array(code, [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes() for p in pieces]
    return merge


def by_ranks(vocab: dict[str, int], special: list[str], size: int, width):
    """Merges pieces by tiktoken. Those that begin with a space and go on without one can be encoded as one text."""
    back = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
    encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    lengths = np.zeros(size, np.int64)
    lengths[list(ranks.values())] = [len(token) for token in ranks]

    def merge(pieces: list[str]) -> list[bytes]:
        joins = [len(p) > 1 and p[0] == " " and not p[1].isspace() for p in pieces]
        many = [p for p, j in zip(pieces, joins) if j]
        ids = encode("".join(many)).astype(width)
        ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum([len(p.encode()) for p in many])) + 1
        data, step, ends = ids.tobytes(), ids.itemsize, ends.tolist()
        found = iter([data[a * step:b * step] for a, b in zip([0, *ends[:-1]], ends)])
        return [next(found) if j else encode(p).astype(width).tobytes() for p, j in zip(pieces, joins)]
    return merge


@lru_cache(4)
def encoder(path: str, library: str = "tokenizers"):
    """A function from texts to id arrays, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    ``library`` merges the pieces that are not cached: "tokenizers", or "tiktoken" where each token's id is its merge's rank.
    Callers bound the texts of one call, as its work space grows with them.
    """
    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens") or []]
    vocab, before = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
    size = max(slow.get_vocab_size(), max(vocab.values()) + 1, 2)
    width = np.uint16 if size <= 1 << 16 else np.uint32
    cache = None
    if spec["model"].get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not spec.get("normalizer"):
        cache = Pieces(by_ranks(vocab, special, size, width) if library == "tiktoken" else by_model(slow.model, "H" if width is np.uint16 else "I"), width)

    def common(texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        begin = piece_starts(points, sizes)
        end = np.r_[begin[1:], len(points)]
        ids, to = cache.all(whole, begin, end, words.span_hashes(points, begin, end))
        cuts = to[np.searchsorted(begin, np.r_[0, np.cumsum(sizes)])]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(texts: list[str]) -> list[np.ndarray]:
        fast = [i for i, t in enumerate(texts) if cache is not None and t and (t.isascii() or not RARE.search(t)) and not any(s in t for s in special)]
        out = dict(zip(fast, common([texts[i] for i in fast]))) if fast else {}
        return [out[i] if i in out else np.array(slow.encode(t, add_special_tokens=False).ids, width) for i, t in enumerate(texts)]

    encode.size, encode.width = size, width
    return encode
