import hashlib

import pytest

from tabularium.llm import sketch
from tests.llm.test_words import sets


def rows_of(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in df.collect())


def test_edits_and_fingerprints(documents, spark):
    for parts in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            made = {r.doc_id: r for r in sketch.with_edits(documents).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        rows = rows_of(documents)
        assert len(made) == len(rows)
        prints = {}
        for i, ((_, doc), text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            half = len(text) // 2
            changed = text[:len(text) - half] + after[:half]
            r = made[doc]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
            for t, f in ((text, r.fingerprint), (changed, r.edited_fingerprint)):
                assert prints.setdefault(t, f) == f
            assert r.near_edited == sketch.likeness(r.fingerprint, r.edited_fingerprint)
            assert r.near_next == sketch.likeness(r.fingerprint, made[rows[(i + 1) % len(rows)][0][1]].fingerprint)
        big = [r for r in made.values() if r.n_chars > 2000]
        assert sum(r.near_edited > r.near_next for r in big) >= 0.99 * len(big)


def test_containment_is_estimated(documents):
    texts = sorted((r.text for r in documents.collect()), key=len)[-12:]
    import pyarrow as pa
    marks, kept = sketch.sketches(pa.array([*texts, *(t + " " + texts[0] for t in texts)]))
    for i, t in enumerate(texts):
        a, b = sets(t), sets(t + " " + texts[0])
        assert sketch.likeness(marks[i], marks[12 + i]) == pytest.approx(len(a & b) / min(len(a), len(b)), abs=0.12)
        assert len(kept[i]) == pytest.approx(len(a) * sketch.SHARE, rel=0.2)
        assert set(sketch.hashes(marks[i])) <= set(sketch.hashes(marks[12 + i]))  # sketches of parts lie in that of the whole


def test_awkward_rows(awkward, nothing):
    made = sketch.with_edits(awkward).collect()
    assert len(made) == awkward.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in made)
    same = {r.fingerprint for r in made if r.doc_id in (4, 5)}
    assert len(same) == 1
    assert sketch.with_edits(nothing).collect() == []
    lone = sketch.with_edits(awkward.where("doc_id = 10")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1
    assert set(sketch.fingerprinted(awkward.drop("fingerprint")).columns) >= {"fingerprint", "node", "text"}
