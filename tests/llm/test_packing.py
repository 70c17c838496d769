import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabularium.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(df, made, window):
    tok = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for r in df.collect():
        want[r.doc_id, bytes(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4"))] += 1
    ids = defaultdict(list)
    for (doc, x), n in want.items():
        ids[doc] += [x] * n
    covered, sequences = defaultdict(int), defaultdict(list)
    for r in made:
        fits = [x for x in ids[r.doc_id] if len(x) // 4 == r.doc_tokens and zlib.crc32(x[4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32]
        assert fits and r.length > 0
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert dict(covered) == {doc: sum(len(x) // 4 for x in xs) for doc, xs in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)  # no padding at all


@pytest.mark.parametrize("window, shard", [(2048, 2_000_000), (64, 5_000)])
def test_every_id_lies_in_one_piece(documents, window, shard):
    check(documents, packing.pack(documents, PATH, window, shard).collect(), window)


def test_awkward_rows(awkward, nothing):
    check(awkward, packing.pack(awkward, PATH).collect(), 2048)
    assert packing.pack(nothing, PATH).collect() == []


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(5)
    ids = [rng.zipf(1.5, rng.integers(5, 60)).clip(max=300).astype(np.uint16) for _ in range(80)]
    seen = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=301)
    idf = np.log1p((80 - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    shard = packing.Shard(ids, idf)
    mean = np.mean([len(x) for x in ids])

    def weights(x):
        terms, tf = np.unique(x, return_counts=True)
        w = idf[terms] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
        return dict(zip(terms.tolist(), w.tolist()))

    terms = [weights(x) for x in ids]
    shard.unused[7] = False
    for seed in range(0, 80, 9):
        score = {d: sum(w for t, w in terms[d].items() if t in terms[seed]) for d in range(80) if d != 7}
        found = shard.neighbours(seed)
        assert set(found) == {d for d, s in score.items() if s > 0}
        assert [score[d] for d in found] == pytest.approx(sorted((score[d] for d in found), reverse=True), rel=1e-4)


def test_related_documents_share_windows(spark):
    rng = np.random.default_rng(6)
    whole = sorted(t[1:] for t in Tokenizer.from_file(PATH).get_vocab() if t[0] == "Ġ" and t[1:].isalpha() and t.isascii() is False and len(t) > 6)
    topics = rng.choice(whole, (20, 30), replace=False)
    rows = [(i, " ".join(rng.choice(topics[i % 20], 40))) for i in range(200)]
    made = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 1024).collect()
    mates = defaultdict(set)
    for r in made:
        mates[r.sequence_id].add(r.doc_id % 20)
    pieces = defaultdict(int)
    for r in made:
        pieces[r.sequence_id] += 1
    assert np.mean([len(mates[s]) / pieces[s] for s in mates if pieces[s] > 1]) < 0.8


def test_long_documents_are_found_by_all_their_terms():
    rng = np.random.default_rng(7)
    ids = [rng.choice(4000, 1500).astype(np.uint16), *(rng.choice(np.arange(200 * i, 200 * i + 200), 60).astype(np.uint16) for i in range(20)),
           *(rng.choice(np.arange(5000, 9000), 300).astype(np.uint16) for _ in range(20))]
    n, mean = len(ids), np.mean([len(x) for x in ids])
    seen = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=9000)
    idf = np.log1p((n - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    shard = packing.Shard(ids, idf)

    def uncut(seed):
        score = np.zeros(n)
        for d, x in enumerate(ids):
            tf = np.bincount(x, minlength=9000)[np.unique(ids[seed])]
            score[d] = (idf[np.unique(ids[seed])] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))).sum()
        return score

    for used in (0, 25):  # more than half used: postings of used documents have been taken out
        shard.unused[n - used:] = False
        for seed in (0, 3, 17):
            score, found = uncut(seed), shard.neighbours(seed)
            score[~shard.unused] = 0
            assert set(found) == set(np.flatnonzero(score))
            assert score[found] == pytest.approx(sorted(score[found], reverse=True), rel=1e-4)
    assert set(range(1, n - 25)) <= set(shard.neighbours(0))


def test_topic_mates_share_a_shard_and_hot_texts_are_split(spark):
    rng = np.random.default_rng(8)
    topics = rng.permutation(np.arange(100, 40_000))[:4000].reshape(100, 40)
    common = np.arange(50_000, 50_200)
    texts = [np.r_[rng.choice(topics[i % 100], 60), rng.choice(common, 60)].astype(np.uint16) for i in range(2000)] + [topics[5].astype(np.uint16)] * 1500
    rows = [(i % 3000, len(x), x.tobytes()) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, doc_tokens long, ids binary").repartition(5)
    seen = np.bincount(np.concatenate([np.unique(x) for x in texts]), minlength=50_300)
    idf = np.log1p((len(texts) - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    tokens = sum(len(x) for x in texts)
    made = packing.dealt(df, seen, idf, len(texts), tokens, np.uint16, 6000).collect()
    assert sorted((r.doc_id, r.ids) for r in made) == sorted((d, x) for d, _, x in rows)
    size, of = defaultdict(int), defaultdict(list)
    for r in made:
        size[r.shard] += r.doc_tokens
        x = np.frombuffer(r.ids, np.uint16)
        if len(x) == 120:
            of[int(np.flatnonzero((topics == x[0]).any(axis=1))[0])].append(r.shard)
    assert max(size.values()) < 2 * 6000 and len(size) == -(-tokens // 6000)
    mates = [np.mean([a == b for i, a in enumerate(s) for b in s[:i]]) for s in of.values()]
    assert np.mean(mates) > 0.1  # a hash of the ids gives 0.02
