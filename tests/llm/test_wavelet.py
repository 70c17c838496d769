import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabularium.llm import bpe, wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(df):
    tok = Tokenizer.from_file(PATH)
    docs = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in df.collect()]
    return docs


def check(df, made):
    """Documents in ascending order without gaps; where an id is repeated, its texts in any order."""
    want = sorted((d is not None, d or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in expected(df))
    got = sorted(made, key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].astype(int).tolist()


@pytest.mark.parametrize("n, levels", [(0, 4), (1, 1), (7, 3), (70_000, 9), (200_000, 17)])
def test_rank_select_and_access(n, levels, monkeypatch):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 2 ** levels - 1).astype(np.uint32 if levels > 16 else np.uint16)
    ends = np.array([n // 3, n // 3, n]) if n else np.zeros(0, int)
    data = wavelet.pack(ids, [5, None, 9][:len(ends)], ends, levels)
    m = wavelet.Matrix(data)
    assert m.n == n and m.tokens().tolist() == ids.tolist() and m.ends.tolist() == ends.tolist() and m.doc_ids.to_pylist() == [5, None, 9][:len(ends)]
    places = rng.integers(0, n, 40).tolist() + [0, n - 1] if n else []
    assert [m.access(i) for i in places] == [int(ids[i]) for i in places]
    for token in {int(t) for t in ids[:50]} | {0, 2 ** levels - 1, 2 ** levels + 3}:
        at = np.flatnonzero(ids == token)
        assert m.count(token) == len(at) and m.occurrences(token).tolist() == at.tolist()
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(token, a, b) == int((ids[a:b] == token).sum())
        for k in {0, len(at) // 2, len(at) - 1, len(at)}:
            assert m.select(token, k) == (int(at[k]) if 0 <= k < len(at) else -1)
    with pytest.raises(IndexError):
        m.access(n)


def test_files_are_smaller_than_the_ids():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.2, 300_000), 50_000).astype(np.uint16)
    assert len(wavelet.pack(ids, [1], np.array([len(ids)]), 16)) < 0.8 * ids.nbytes
    with pytest.raises(ValueError):
        wavelet.Matrix(b"x" * 100)


@pytest.mark.parametrize("shard", [wavelet.SHARD_TOKENS, 5000])
def test_documents_come_back(spark, documents, shard):
    path = wavelet.written(documents, PATH, shard)
    check(documents, wavelet.documents(spark, path).collect())
    files = spark.read.parquet(path)
    assert files.count() >= (20 if shard == 5000 else 1)
    names = [f for f in files.inputFiles()]
    rows = {tuple(r) for r in files.selectExpr("input_file_name() AS f", "part", "number").collect()}
    assert len(rows) == len({f for f, _, _ in rows}) <= len(names)  # one shard per file


def test_counts_and_occurrences(spark, documents):
    path = wavelet.written(documents, PATH, 9000)
    docs = sorted(expected(documents))
    whole = np.concatenate([x for _, x in docs])
    tokens = [0, int(whole[0]), int(whole[777]), 50_256, 49_999]
    assert {r.token: r.n for r in wavelet.counts(spark, path, tokens).collect()} == {t: int((whole == t).sum()) for t in tokens}
    token = int(whole[777])
    want = [(d, i) for d, x in docs for i, t in enumerate(x) if t == token]
    got = sorted(tuple(r) for r in wavelet.occurrences(spark, path, token).collect())
    assert [r[:2] for r in got] == want and sorted(r[2] for r in got) == np.flatnonzero(whole == token).tolist()


def test_awkward_rows(spark, awkward, nothing):
    check(awkward, wavelet.documents(spark, wavelet.written(awkward, PATH)).collect())
    check(awkward, wavelet.documents(spark, wavelet.written(awkward, PATH, 3)).collect())
    empty = wavelet.written(nothing, PATH)
    assert wavelet.documents(spark, empty).collect() == [] and wavelet.counts(spark, empty, [1]).collect() == []


@pytest.mark.parametrize("library", ["tokenizers", "tiktoken"])
def test_ids_are_those_of_tokenizers(documents, awkward, library, monkeypatch):
    texts = [r.text or "" for r in documents.collect() + awkward.collect()] + [
        "<|endoftext|>a", "I'm  here\n\n  now ", "żółć ͸ ǅ", "١٢٣", "a­b", "\U0001f600", "'s't 'll x'LL", "a\x1cb\x85 \xa0c", " \t\r\n" * 9, "é²½ 12ª", "x" * 3000, "  "]
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "MOST_PIECES", 500)
    assert [x.tolist() for x in bpe.encoder(PATH, library)(texts)] == want
    other = public_tokenizers.path("word_bpe_49k.json")
    assert [x.tolist() for x in bpe.encoder(other, library)(["A word, or two"])] == [Tokenizer.from_file(other).encode("A word, or two", add_special_tokens=False).ids]


def test_pieces_are_those_of_the_pattern():
    rng = np.random.default_rng(4)
    letters = [*"aestmdrvlZéß09²½", *["'"] * 5, *".,-<|", *[" "] * 5, "\n", "\t", "\xa0", "\x85", "\x1c", "\r", "’", "€"]
    pattern = bpe.regex.compile(bpe.PATTERN)
    for _ in range(400):
        texts = ["".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(rng.integers(1, 6))]
        whole = "".join(texts)
        starts = bpe.piece_starts(np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts]))
        assert [whole[a:b] for a, b in zip(starts, np.r_[starts[1:], len(whole)])] == [p for t in texts for p in pattern.findall(t)]


def test_pieces_of_one_place_are_told_apart(monkeypatch):
    """Hashes that want one place of the table, pieces too long to keep, more pieces than it takes, and starting anew."""
    monkeypatch.setattr(bpe, "MOST_PIECES", 40)
    monkeypatch.setattr(bpe, "LONGEST_PIECE", 6)
    asked = []
    cache = bpe.Pieces(lambda pieces: [np.array([ord(c) for c in p if c != "-"], np.uint16).tobytes() for p in pieces if not asked.append(p)], np.uint16)
    rng = np.random.default_rng(3)
    vocabulary = ["a", "", "-", "long" * 5, *("w" + "xyz"[i % 3] * (i % 4) + str(i) for i in range(90))]
    hashes = np.array([(i % 3) + 160 * (i // 3 + 1) for i in range(len(vocabulary))], np.uint64)  # three places of 160
    for size, some in ((30, 12), (30, 12), (200, 30), (500, 94), (3, 94), (30, 12)):
        which = rng.integers(0, some, size)
        before = len(asked)
        ends = np.cumsum([len(vocabulary[i]) for i in which])
        ids, to = cache.all("".join(vocabulary[i] for i in which), np.r_[0, ends[:-1]], ends, hashes[which])
        assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:])] == [[ord(c) for c in vocabulary[i] if c != "-"] for i in which]
        new = asked[before:]
        assert len(new) == len(set(new))  # each piece is merged once
    asked.clear()
    cache.all("a", np.array([0]), np.array([1]), hashes[:1])
    cache.all("a", np.array([0]), np.array([1]), hashes[:1])
    assert len(asked) <= 1
