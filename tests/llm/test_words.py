import re

import numpy as np
import pyarrow as pa

from tabularium.llm import words


def sets(text, k=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i:i + k]) for i in range(len(found) - k + 1)} if len(found) >= k else ({tuple(found)} if found else set())


def test_shingle_sets_are_those_of_plain_python(documents, awkward):
    texts = [r.text for r in documents.select("text").collect()] + [r.text for r in awkward.select("text").collect()]
    values, at = words.shingle_sets(pa.array(texts))
    plain = [sets(t) for t in texts]
    assert np.diff(at).tolist() == [len(s) for s in plain]
    seen = {}
    for s, a, b in zip(plain, at[:-1], at[1:]):
        assert seen.setdefault(frozenset(s), values[a:b].tobytes()) == values[a:b].tobytes()
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 1000, "", "c"] * 7)], names=["text"])
    parts = list(words.slices(batch, "text", 100, 4))
    assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([batch]))
    assert max(p.num_rows for p in parts) <= 4
    assert list(words.slices(batch.slice(0, 0), "text")) == []
