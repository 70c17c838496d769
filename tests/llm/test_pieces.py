import functools
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tabularium.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def best(text, score):
    """The best score of any segmentation, by plain recursion."""
    @functools.cache
    def at(end):
        return 0.0 if end == 0 else max((at(b) + score[text[b:end]] for b in range(max(0, end - 16), end) if text[b:end] in score), default=-1e18)
    return at(len(text))


def test_segmentations_are_the_best(documents):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = {w for r in documents.select("text").limit(60).collect() for w in r.text.split()}
    known = pieces.vocabulary(PATH)
    score = {model.id_to_piece(i): model.get_score(i) for i in range(259, model.get_piece_size())}
    for w, ids in zip(found, known.encode(list(found))):
        assert sum(map(model.get_score, ids.tolist())) == pytest.approx(best(model.normalize(w), score))
        assert "".join(map(model.id_to_piece, ids.tolist())) == model.normalize(w)


def test_round_trip(documents, awkward, nothing):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for df in (documents, awkward):
        texts = {(r.doc_id, r.text or "") for r in df.collect()}
        rows = pieces.digested(df, PATH).collect()
        assert len(rows) == df.count()
        for r in rows:
            back = model.decode(r.ids)
            assert r.n_pieces == len(r.ids) and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
            assert r.round_trip == ((r.doc_id, back) in texts) or "▁" in "".join(t for i, t in texts if i == r.doc_id)
    assert pieces.digested(nothing, PATH).collect() == []
    long = "x" * 3000
    assert pieces.vocabulary(PATH).decode(pieces.vocabulary(PATH).encode([long])[0].tolist()) == long


def test_columns_stay(awkward):
    made = pieces.decoded(pieces.encoded(awkward.drop("ids"), PATH), PATH).where("doc_id <> 14")
    assert {"node", "score", "ids", "decoded"} <= set(made.columns)
    assert made.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
