import numpy as np

from tabularium.llm import vectors
from tests.llm.test_minhash import groups


def expected(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links, count = [], {}
    for n, (a, x) in enumerate(good):
        for m, (b, y) in enumerate(good):
            if n != m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((a, b))
                count[n] = count.get(n, 0) + 1
    label = groups(links, {i for i, _ in rows if i is not None})
    return sorted([(i, count.get(n, 0), label[i], label[i] == i) for n, (i, _) in enumerate(good)]
                  + [(i or 0, 0, label.get(i, 0), i is None or label[i] == i) for i, v in rows if not any(i == g and np.array_equal(v, w) for g, w in good)])


def made(df):
    return sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.near_duplicates(df).collect())


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows, at = [], 0
    for size, noise in ((1, 0), (200, 0.1), (40, 0.16), (30, 0.2), (5, 0.02)):
        centre = rng.normal(size=16)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((at, (centre + rng.normal(size=16) * noise / 4).astype(np.float32).tolist()))
            at += 3
    rows += [(at + i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(150)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node long").repartition(7)
    assert made(df) == expected(rows)


def test_awkward_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(1, same), (2, same), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]),
            (9, [1.0, 2.0]), (10, [2.0, 4.0, 6.0]), (11, [-1.0, -2.0, -3.0]), (None, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = made(df)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (10, 2, 1, False), (11, 0, 11, True), (9, 0, 9, True), (0, 0, 0, True),
                          *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8))])
    assert made(df.where("false")) == []
    twice = spark.createDataFrame([(1, same), (1, same)], "vec_id long, embedding array<float>")
    assert made(twice) == [(1, 1, 1, True)] * 2


def test_groups_beyond_the_window_and_the_tile(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(9)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.05).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, window=8).collect())
    assert got == expected(rows)
