import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tabularium.llm import chat

ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\ <s>[/INST]"), (1, 2, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "b"),
        (2, None, "system", "first"), (None, 0, "user", "no id"), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, "</s>", "<s>é☃")]


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(t for r, t in turns if r == "assistant") for c, turns in out.items()}
    return {c: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), len(loss[c]), digest(loss[c])) for c, t in out.items()}


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, seq long")


def test_digests_read_back(spark):
    rows = ROWS + [(9, i, "user" if i % 2 else "assistant", f"turn {i} <s>" * (i % 5)) for i in range(200)]
    made = {r.conv_id: r for r in chat.digests(table(spark, rows)).collect()}
    want = expected(rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in made.items()} == want
    assert not any(r.rewritten for r in made.values())
    assert chat.digests(table(spark, [])).collect() == []


def test_long_conversations_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPLIT", 40)
    rows = ROWS + [(9, i // 3, "user" if i % 2 else "assistant", f"turn {i} <s>" * (i % 5)) for i in range(700)]
    rows += [(None, i, "assistant", f"{i}") for i in range(1, 300)]
    df = table(spark, rows)
    made = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(df).collect()}
    assert made == expected(rows)

    def numbered(turns):  # the first turn looks different, and each one shows the role before
        return "".join(f"{'first' if i == 0 else turns[i - 1][0]}|{r}>{t};" for i, (r, t) in enumerate(turns))

    long = sorted((r.seq, r.piece, r.text_begin, r.text_end) for r in chat.formatted(df, numbered).where("conv_id = 9").collect())
    turns = [(r, t) for c, i, r, t in sorted(rows, key=lambda r: (r[1] or 0, r[2] or "", r[3] or "")) if c == 9]
    assert [s for s, *_ in long] == list(range(700))
    assert "".join(p for _, p, _, _ in long) == numbered(turns)
    assert [p[a:b] for _, p, a, b in long] == [t for _, t in turns]
    tasks = chat.ranged(chat.parted(chat.turns_of(df), 4)[1], chat.marked, 64, 4)
    from pyspark.sql import functions as F
    share = tasks.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert share < 400  # of 1000


def test_pieces_join_to_the_whole_rendering(spark):
    made = chat.formatted(table(spark, ROWS)).collect()
    turns = [(r[2] or "", r[3] or "") for r in ROWS[:3]]
    mine = sorted((r.seq, r.piece) for r in made if r.conv_id == 1)
    assert "".join(p for _, p in mine) == chat.marked(turns)
    for r in made:
        assert r.piece[r.text_begin:r.text_end] == chat.escape(chat.read(r.piece)[0][1])


@given(st.lists(st.tuples(st.text("<s>/[INST]\\a", max_size=12), st.text("<s>/[INST]\\a", max_size=12)), max_size=5))
def test_escapes_are_reversible(turns):
    assert chat.read(chat.marked(turns)) == turns


def test_templates_that_rewrite_history_are_detected():
    def last_only(turns):  # drops earlier answers' texts, as templates do that hide old reasoning
        return "".join(f"({r}:{t if i == len(turns) - 1 or r == 'user' else '-'})" for i, (r, t) in enumerate(turns))

    def greeting(turns):
        return "<start>" + "".join(f"|{r}>{t}\n" for r, t in turns)

    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "aab")]
    assert [p[1] is None for p in chat.pieces(iter(turns), last_only, 64)] == [False, False, True, False]
    for window in (1, 2, 64):
        found = list(chat.pieces(iter(turns), greeting, window))
        assert [p[b:e] for _, p, b, e in found] == [t for _, t in turns]
        assert "<start>" + "".join(p for _, p, _, _ in found) == greeting(turns)


def by_number(turns):
    return "".join(f"[{i}:{r}]{t}" for i, (r, t) in enumerate(turns))


def forgetful(turns):
    """Blanks the texts of turns older than the last 80."""
    return "".join(f"({r}:{t if i >= len(turns) - 80 else ''})" for i, (r, t) in enumerate(turns))


def of_system(turns):
    """Every turn shows the leading system turn's text."""
    lead = turns[0][1] if turns and turns[0][0] == "system" else "-"
    return "".join(f"<{lead}|{r}>{t}" for r, t in turns)


@pytest.mark.parametrize("template", [by_number, forgetful, of_system])
@pytest.mark.parametrize("n", [65, 200, 5000])
def test_cuts_are_proven_by_rendering(template, n):
    turns = [("system", "be brief")] + [("user" if i % 2 else "assistant", f"t{i}") for i in range(n - 1)]
    found = list(chat.pieces(iter(turns), template, 64))
    assert len(found) == n
    if template is forgetful:
        assert [p is None for _, p, _, _ in found] == [i >= 80 for i in range(n)]
        return
    assert "".join(p for _, p, _, _ in found) == template(turns)
    assert [p[a:b] for _, p, a, b in found[1:]] == [t for _, t in turns[1:]]  # the system turn's piece may show its text twice
    assert list(chat.pieces(iter(turns[:150]), template, 64)) == list(chat.steps(iter(turns[:150]), template, []))


def test_local_templates_are_rendered_in_short_contexts():
    seen = []

    def short(turns):
        seen.append(len(turns))
        return chat.marked(turns)
    short.local = True
    turns = [("user", f"t{i}") for i in range(500)]
    assert "".join(p for _, p, _, _ in chat.pieces(iter(turns), short, 64)) == chat.marked(turns) and max(seen) <= 64
    seen.clear()
    short.local = False
    assert "".join(p for _, p, _, _ in chat.pieces(iter(turns), short, 64)) == chat.marked(turns) and sum(seen) < 70 * 3 * 500


@pytest.mark.parametrize("a, b", [("", ""), ("ab", "ab"), ("ab", "ac"), ("x" * 1000 + "a", "x" * 1000 + "b"), ("a", ""), ("ab", "abc")])
def test_common(a, b):
    import os
    assert chat.common(a, b) == len(os.path.commonprefix([a, b]))
