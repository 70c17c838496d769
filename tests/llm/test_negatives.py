import math

import numpy as np
import pytest

from tabularium.llm import negatives


def expected(rows, every=100):
    """All pairs, window by window."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        good[i, tuple(v), label] = (i, label, [math.floor(256 * x) if abs(x) < 1e300 else int(x) for x in v])
    out = []
    for i, label, v in good.values():
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good.values() if len(w) == len(v))
        near = [(-s, j) for s, j, other in scored if other == label and j != i][:5]
        for p, j in near:
            far = [(-s, k) for s, k, other in scored if other != label and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(far)]
    return sorted(out)


def made(df, **how):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **how).collect())


SCHEMA = "vec_id long, embedding array<double>, label int, slot int, score double"


def test_windows_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 8)
    monkeypatch.setattr(negatives, "PART", 100)
    monkeypatch.setattr(negatives, "CELLS", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i), (centres[i % 12] + rng.normal(size=8) * 0.4).tolist(), int(rng.integers(10))) for i in rng.permutation(700)]
    rows += [(1000 + i, [0.5] * 8, i % 3) for i in range(250)]  # copies: ties in scores and in limits
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA).repartition(6)
    want = expected(rows, 10)
    assert len(want) > 1000 and made(df, anchor_every=10) == want


def test_whole_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    got = negatives.hard_negatives(df)
    assert [(c, t) for c, t in got.dtypes] == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                                               ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_awkward_rows(spark):
    one, two = [1.0, 1.0], [0.5, 0.75]
    rows = [(100, one, 1), (100, one, 1), (200, one, 1), (200, two, 1), (300, two, None), (None, one, 1), (400, None, 1), (401, [1.0, None], 1),
            (402, [1.0, float("nan")], 1), (403, [float("inf"), 1.0], 1), (500, [], 1), (501, [], 2), (7, one, 9), (14, two, 0), (8, two, 2), (9, two, 2),
            (600, [0.0, 0.0], 1), (601, [0.0, 0.0], 2), (800, [-1.0, -1.0], 3), (801, one, 3), (900, [1.0, 2.0, 3.0], 4), (901, [1.0, 2.0, 3.0], 4),
            (902, [0.5, 1.0, 1.5], 5)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA)
    assert made(df) == expected(rows)
    assert made(df.where("false")) == [] and made(df.where("vec_id = 100")) == []


def test_large_components_are_exact(spark):
    big = 2.0 ** 22
    rows = [(100, [big + 1, 3.0], 1), (1, [big + 1, 5.0], 1), (2, [big / 2 + 1, 7.0], 2), (3, [big / 2 + 1, 6.0], 2), (4, [1e250, 1.0], 3)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA)
    got = made(df)
    assert got == expected(rows) and len(got) == 2


@pytest.mark.parametrize("k", [1, 3])
def test_best_keeps_the_first_by_score_and_id(k):
    rng = np.random.default_rng(k)
    best, all_rows = negatives.Best(4, k), []
    for _ in range(5):
        slot, score, ids = rng.integers(0, 4, 30), rng.integers(-3, 3, 30), rng.permutation(1000)[:30]
        best.add(slot, score, ids)
        all_rows += zip(slot.tolist(), (-score).tolist(), ids.tolist())
    want = [r for s in range(4) for r in sorted(x for x in all_rows if x[0] == s)[:k]]
    assert list(zip(best.slot.tolist(), (-best.score).tolist(), best.id.tolist())) == want
