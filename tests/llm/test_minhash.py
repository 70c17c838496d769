import numpy as np
import pyarrow as pa
import pytest

from tabularium.llm import minhash, words
from tabularium.llm.components import components
from tests.llm.test_words import sets


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(rows, percent=85):
    by = [(i, sets(t)) for i, t in rows if i is not None]
    links = [(a, b) for n, (a, x) in enumerate(by) for b, y in by[:n] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return groups(links, {i for i, _ in by})


def check(rows, made):
    label = expected(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in made) == sorted((i is None, i or 0, len(sets(t))) for i, t in rows)
    for r in made:
        assert r.component_id == label.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_groups_are_those_of_all_pairs(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(rows, minhash.near_duplicates(documents).collect())


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check(rows, minhash.near_duplicates(awkward).collect())
    assert minhash.near_duplicates(nothing).collect() == []


def test_chains_and_unlinked_near_copies_meet_in_tiles(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):  # near copies of one text, few of which are near each other
        text = list(base)
        for j in rng.choice(150, 3, replace=False):
            text[j] = f"r{i}x{j}"
        rows.append((i, " ".join(text)))
    chain = list(base)
    for i in range(100, 130):  # each near the one before only
        chain[(i * 2) % 150] = f"c{i}"
        rows.append((i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, minhash.near_duplicates(docs).collect())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        n = int(400 * (1 - share) / 2 / share)
        both, one = rng.integers(0, 1 << 63, 400), rng.integers(0, 1 << 63, 2 * n)
        a, b = np.unique(np.r_[both, one[:n]]), np.unique(np.r_[both, one[n:2 * n]])
        sig = minhash.superminhash(np.r_[a, b].astype(np.uint64), np.array([0, len(a), len(a) + len(b)]), 256)
        assert (sig[0] == sig[1]).mean() == pytest.approx(len(both) / (len(both) + 2 * n), abs=0.12)
    tiny = minhash.superminhash(np.array([5], np.uint64), np.array([0, 1, 1]), 64)
    assert (tiny[0] != minhash.EMPTY).all() and (tiny[1] == minhash.EMPTY).all()
    assert sorted(tiny[0] >> np.uint64(54)) == list(range(64))  # one element fills each slot with a rank of its own


def test_early_stop_changes_nothing():
    """Every round of every element, without dropping sets that are full."""
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    fast = minhash.superminhash(values, np.array([0, 700]), 16)[0]
    slow = np.full(16, minhash.EMPTY)
    for v in values:
        perm = list(range(16))
        for j in range(16):
            draw = words.mix(np.array([v]) + words.GOLDS[j + 1])[0]
            k = j + (int(draw) & 0xFFFFFF) * (16 - j) // (1 << 24)
            perm[j], perm[k] = perm[k], perm[j]
            slow[perm[j]] = min(slow[perm[j]], np.uint64(j) << np.uint64(54) | draw >> np.uint64(10))
    assert (fast == slow).all()


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5, None)]
    made = components(spark.createDataFrame(pairs, "a long, b long").repartition(5))
    real = [(a, b) for a, b in pairs if b is not None and a != b]
    label = groups(real, {x for p in real for x in p})
    assert {r.node: r.component for r in made.collect()} == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
