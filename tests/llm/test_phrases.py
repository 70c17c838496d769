import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pytest

from tabularium.llm import phrases

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def expected(rows, least, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    f = {x: a for x, a in f.items() if a >= least}
    dropped = {(x[0], *x[1 + i:1 + j]) for x, a in f.items() for i in range(len(x) - 1) for j in range(i + 1, len(x))
               if j - i < len(x) - 1 and f[(x[0], *x[1 + i:1 + j])] <= a}
    out = []
    for lang in n:
        found = []
        for x, a in f.items():
            if x[0] == lang and len(x) > 2 and x not in dropped:
                cuts = [(1000 * a * n[lang] // (f[x[:k + 1]] * f[(lang, *x[k + 1:])]), k) for k in range(1, len(x) - 1)]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(x[1:]).encode(), f[x[:k + 1]], f[(lang, *x[k + 1:])]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(df, **how):
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


def corpus(seed, texts=300):
    """Frequent and rare words, fixed phrases inside longer ones, repeated words, and characters that end pieces."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Łódź", "É", "é", "x\x0by", "tab\there", "a", "A", "日本"]
    fixed = [" ".join(rng.choice(vocabulary, rng.integers(2, 8))) for _ in range(25)]
    rows = []
    for _ in range(texts):
        parts = [str(rng.choice(fixed)) if rng.random() < 0.3 else vocabulary[min(int(rng.zipf(1.4)) - 1, len(vocabulary) - 1)] for _ in range(rng.integers(0, 60))]
        text = "".join(p + str(rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!"])) for p in parts)
        rows.append((text, [None, "en", "fr", "de"][rng.integers(4)]))
    return rows


@pytest.mark.parametrize("least, top, bands", [(5, 2000, phrases.BANDS), (3, 12, (0.1, 0.3, 0.6, 1)), (8, 3, (0.02, 1))])
def test_phrases_are_those_of_plain_counting(spark, least, top, bands):
    rows = corpus(least)
    df = spark.createDataFrame([(*r, 1.5, True) for r in rows], "text string, lang string, score double, known boolean").repartition(5)
    want = expected(rows, least, top)
    assert len(want) >= 4 * min(top, 20) and made(df, least=least, top=top, bands=bands) == want


def test_ties_at_the_limit_are_settled(spark):
    rows = [(f"p{i} q{i}. " * 4, "en") for i in range(30)] + [("common word. " * 50, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    want = expected(rows, 4, 10)
    assert len({r[-1] for r in want}) == 1 and made(df, least=4, top=10, bands=(0.01, 1)) == want


def test_first_words_below_the_bound_are_not_expanded(spark, monkeypatch):
    rows = [(f"r{i} s{i} t{i}. " * 3, "en") for i in range(40)] + [("the of. the at. " * 300, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    opened = []
    grow = phrases.Growth.grow
    monkeypatch.setattr(phrases.Growth, "grow", lambda self, band: (opened.append(band.count()), grow(self, band)))
    assert made(df, least=3, top=10, bands=(0.05, 1)) == expected(rows, 3, 10)
    assert opened == [120, 0]  # "the", "of" and "at" are closed by their bounds


def test_domination_by_a_longer_phrase_that_begins_with_a_closed_word(spark):
    rows = [("the new york. " * 5, "en")] + [("the a. the b. the c " * 100, "en")] + [(f"x{i} y{i}. " * 5, "en") for i in range(5)]
    want = expected(rows, 4, 5)
    assert not any(r[2] == "new york" for r in want)
    assert made(spark.createDataFrame(rows, "text string, lang string"), least=4, top=5, bands=(0.02, 1)) == want


def test_long_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "SLICE", 300)
    monkeypatch.setattr(phrases, "ROW", 20)
    rows = [("one two three four five six seven " * 2000, "en")] + [("one two three", "en")] * 50 + [(None, "en"), ("", None), (" .,\n", None), ("alone", "es")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert made(df, least=40) == expected(rows, 40, 2000)
    assert made(df.where("false")) == [] and made(spark.createDataFrame([(None, None)], "text string, lang string")) == []


def test_awkward_rows(awkward):
    rows = [(r.text, r.lang) for r in awkward.collect()]
    assert made(awkward, least=2) == expected(rows, 2, 2000)


def test_words_and_pieces():
    found = phrases.Words(pa.array(["A b,c  d", "", None, "e\x0cf g", "h"]), ["x"] * 5)
    assert [found.word(i) for i in range(len(found.begin))] == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert (np.diff(found.piece) != 0).tolist() == [False, True, False, True, True, False, True]
