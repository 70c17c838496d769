import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import labelled, quality, toxicity


@pytest.mark.parametrize("module, label, cut, least", [(quality, "quality", 0.5, 0.97), (toxicity, "toxic", 0.7, 0.9)])
def test_held_out_accuracy(spark, module, label, cut, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    rows = docs.join(labels, "doc_id").select("doc_id", label, model.column("text").alias("p")).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.p >= cut) == bool(r[label]) for r in held]) >= least
    if label == "toxic":
        assert np.mean([r.p >= cut for r in held if not r[label]]) <= 0.02


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_awkward_rows(spark, awkward, nothing, labels, module, label):
    few = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, 0, 1), (None, 1, 1), (9, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    scores = [r.p for r in awkward.select(module.fit(awkward, few).column("text").alias("p")).collect()]
    assert len(scores) == awkward.count() and all(0 <= s <= 1 for s in scores)
    blank = awkward.select(module.fit(awkward, labels.where("false")).column("text").alias("p")).collect()
    assert {r.p for r in blank} == {0.5}
    assert nothing.select(module.fit(nothing, few).column("text").alias("p")).collect() == []


def test_teaching_is_bounded_and_leaves_the_held_out_part(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    taught = labelled.teaching(rows, "quality", 100).collect()
    assert len(taught) == 100 and not any(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in taught)
    assert labelled.teaching(rows.unionByName(rows), "quality", 5000).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(3000))


def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9000, 3))
    y = (rng.random(9000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = labelled.Network(x[:3000], y[:3000], hidden=6)
    p = net.score(x[3000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        some = (p >= low) & (p < low + 0.25)
        assert y[3000:][some].mean() == pytest.approx(p[some].mean(), abs=0.1)
    assert labelled.Network(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_whole_words_compress_to_their_own_length():
    known = toxicity.Distance([b"dreadful", b"horrid"], [b"plain", b"words", b"here"])
    import pyarrow as pa
    gain, docs = known.gains(pa.array(["Dreadful plain words", None, "here dreadfulness horrid", "a b"]))
    assert docs.tolist() == [0, 3, 3, 6, 6] and (gain[[0, 5]] > 0).all() and (gain[[1, 2, 3, 4]] == 0).all()


@pytest.mark.parametrize("n", [5, 8, 10, 12, 14, 3000])
def test_every_dictionary_word_is_a_hit(n):
    import pyarrow as pa
    rng = np.random.default_rng(n)
    made = list(dict.fromkeys("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 10))) for _ in range(n + 800)))
    toxic, ordinary = made[:n], made[n:n + 500]
    known = toxicity.Distance([w.encode() for w in toxic], [w.encode() for w in ordinary])
    gain, _ = known.gains(pa.array([" ".join(toxic)]))
    assert len(gain) == n and (gain > 0).all()
    other, _ = known.gains(pa.array([" ".join(ordinary)]))
    assert (other == 0).all()


def test_rare_toxic_words_are_kept(spark):
    rng = np.random.default_rng(12)
    common = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(400)]
    taught = [i for i in range(7000) if zlib.crc32(str(i).encode()) % 3 != 1][:4000]
    rows = []
    for place, i in enumerate(taught):
        text = list(rng.choice(common, 30))
        if place < 2000:
            text[5] = "often" + "xyz"[place % 3] * 4
            if place % 100 == 0:
                text[9] = "seldomqq"  # 20 of 2,000 would pass the old floor
            if place % 125 == 1:
                text[12] = "rarelyzz"  # 16 of 2,000
            if place % 500 == 2:
                text[14] = "chancevv"  # 4 of 2,000 are no evidence
        rows.append((i, " ".join(text), int(place < 2000)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    known = model.distance.content[0]
    assert b" seldomqq " in known and b" rarelyzz " in known and b" chancevv " not in known
    assert not any(b" " + w.encode() + b" " in known for w in common)
