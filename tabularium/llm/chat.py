"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive prefixes of a conversation are rendered;
as long as each output begins with the one before, the rest of it is the new turn's piece. Two more renderings with other texts
in the last turn show where in its piece the text stands: their outputs differ there and nowhere else. A template whose output
does not begin with the one before rewrites history; then pieces cannot be told apart, which the rows say.

Conversations are sorted by turn inside tasks. The first ``WINDOW`` turns are rendered from the beginning. Further turns are rendered
from the turns shortly before them, in blocks that double, and the rendering of everything up to a block's end must then be the
pieces so far, one after another; where it is not, the block is rendered again from the whole prefix, turn by turn. So no cut
changes a piece that the whole rendering shows.

A template that declares ``local = True`` promises that a turn's piece depends on the turn and the one before it only. Its conversations
stream in bounded memory without proofs, and the few that hold more than a task's share of all rows are cut into ranges of turns,
which different tasks render, each from the last turn of the range before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.store import partitions

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
WINDOW = 64
#: Conversations of fewer turns are never cut, and a longer one into so many ranges at most.
SPLIT, RANGES = 4096, 256
PROBES = ("a", "b")
#: Strings that mark turns; inside roles and texts they are escaped.
BEGIN, HEAD, TAIL, END = "<s>", "[INST]", "[/INST]", "</s>"
_control = re.compile("|".join(map(re.escape, (BEGIN, HEAD, TAIL, END))))
_turn = re.compile(re.escape(BEGIN + HEAD) + "(.*?)" + re.escape(TAIL) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes and puts one inside each control string, so that none is left."""
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked(turns: list[Turn]) -> str:
    """The template of this library: each turn is <s>[INST]role[/INST]text</s> with control strings escaped."""
    return "".join(f"{BEGIN}{HEAD}{escape(role)}{TAIL}{escape(text)}{END}" for role, text in turns)


marked.local = True


def read(formatted: str) -> list[Turn]:
    """The turns of a text that ``marked`` has made."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def common(one: str, other: str) -> int:
    """The length of the common prefix."""
    n, low = min(len(one), len(other)), 0
    while low < n:  # doubling halves, so that long equal beginnings are compared by slices
        step = max(1, (n - low) // 2)
        if one[low:low + step] == other[low:low + step]:
            low += step
        elif step == 1:
            break
        else:
            n = low + step
    return low


Piece = tuple[str, str | None, int | None, int | None]


def steps(turns: Iterator[Turn], template: Template, before: list[Turn]) -> Iterator[Piece]:
    """Pieces by rendering every prefix from ``before`` on, which grows by the turns."""
    shown = template(before)
    for turn in turns:
        now = template([*before, turn])
        if now.startswith(shown):
            piece = now[len(shown):]
            one, other = (template([*before, (turn[0], probe)])[len(shown):] for probe in PROBES)
            begin = common(one, other)
            after = common(one[::-1], other[::-1])
            yield turn[0], piece, begin, len(piece) - after
        else:
            yield turn[0], None, None, None
        before.append(turn)
        shown = now


def windowed(turns: Iterator[Turn], template: Template, window: int, before: list[Turn]) -> Iterator[Piece]:
    """Pieces by rendering at most ``window`` turns together, each time from the last turn on."""
    while part := list(islice(turns, max(1, window - len(before)))):
        yield from steps(iter(part), template, before)
        before = before[-1:]


def pieces(turns: Iterator[Turn], template: Template, window: int, first: list[Turn] = ()) -> Iterator[Piece]:
    """For each turn its role, its piece and where its text begins and ends in the piece; None where history is rewritten.

    ``first`` are turns that stand before these ones and have been rendered elsewhere. Templates that are not local keep a whole
    conversation in memory, and render it quadratically in turns where it does not follow from shorter contexts."""
    before, turns = list(first), iter(turns)
    if getattr(template, "local", False):
        yield from windowed(turns, template, window, before)
        return
    yield from steps(islice(turns, max(1, window)), template, before)
    while block := list(islice(turns, len(before))):
        shown, whole = template(before), template([*before, *block])
        found = list(windowed(iter(block), template, window, before[-1:]))
        if all(p is not None for _, p, _, _ in found) and whole == shown + "".join(p for _, p, _, _ in found):
            yield from found
            before += block
        else:
            yield from steps(iter(block), template, before)


def rendered(template: Template, window: int, starts: dict[int, int]):
    """Pieces of the turns of a task in order; ``starts`` has the place of each range's first turn. A row that stands in front of
    a range as its context is rendered with it but not put out."""
    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "range", "context", "role", "text")))

    def make(batches):
        out = []
        for (conv, part), turns in groupby(rows(batches), key=lambda r: r[:2]):
            turns, first = iter(turns), []
            head = next(turns)
            if head[2]:
                first = [(head[3] or "", head[4] or "")]
            else:
                turns = chain([head], turns)
            plain = ((r[3] or "", r[4] or "") for r in turns)
            for seq, found in enumerate(pieces(plain, template, window, first), starts.get(part, 0)):
                out.append((conv, seq, *found))
                if len(out) >= 512:
                    yield block(out)
                    out = []
        yield block(out)
    return make


def block(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = ("conv_id", "seq", "role", "piece", "text_begin", "text_end")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list(names))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean"
ROW = "conv_id long, seq long, role string, piece string, text_begin long, text_end long"


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def parted(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame | None]:
    """Turns of ordinary conversations, and those of long ones (None if there are none).

    Long are those of more than SPLIT turns that hold more than one of ``parts`` parts of all rows, so ``parts`` at most.
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    total = rows.count()
    long = [r.conv_id for r in sizes.where(F.col("n") > max(SPLIT, total / parts)).select("conv_id").collect()]
    if not long:
        return rows, None
    test = F.coalesce(F.col("conv_id").isin([c for c in long if c is not None]), F.lit(False)) | (F.col("conv_id").isNull() & F.lit(None in long))
    return rows.where(~test), rows.where(test)


def ranged(rows: DataFrame, template: Template, window: int, parts: int) -> DataFrame:
    """Pieces of long conversations: each is cut at quantiles of its turns, and every range starts from the last turn before it."""
    lowest = -(1 << 63)
    rows = rows.withColumn("pos", F.coalesce("turn", F.lit(lowest)))
    steps = min(parts, RANGES)
    cuts = rows.groupBy("conv_id").agg(F.percentile_approx("pos", F.array(*[F.lit(i / steps) for i in range(1, steps)]) if steps > 1 else F.array(F.lit(0.5)), 10_000).alias("cuts")).collect()
    bounds, base = {}, {}
    for r in cuts:
        bounds[r.conv_id] = np.unique(r.cuts)
        base[r.conv_id] = sum(len(b) + 1 for b in bounds.values()) - len(bounds[r.conv_id]) - 1

    def place(conv: pa.Array, pos: pa.Array) -> pa.Array:
        return pa.array([base[c] + int(np.searchsorted(bounds[c], p, "right")) for c, p in zip(conv.to_pylist(), pos.to_pylist())], pa.int32())

    rows = rows.withColumn("range", F.arrow_udf(place, "int")("conv_id", "pos"))
    last = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.max(F.struct("pos", "turn", "role", "text")).alias("last"))
    ends = sorted(last.select("range", "n", "conv_id").collect(), key=lambda r: r.range)  # one row per range
    starts, follows = {}, {}
    for before, here in zip(ends, ends[1:]):
        if before.conv_id == here.conv_id:
            starts[here.range] = starts.get(before.range, 0) + before.n
            follows[before.range] = here.range
    after = F.element_at(F.create_map(*[F.lit(x) for pair in {-1: -1, **follows}.items() for x in pair]), F.col("range"))
    context = (last.withColumn("range", after.cast("int")).where("range >= 0")
               .select("conv_id", "last.turn", "last.role", "last.text", "last.pos", "range").withColumn("context", F.lit(True)))
    count = sum(len(b) + 1 for b in bounds.values())
    return (rows.withColumn("context", F.lit(False)).unionByName(context).repartitionById(count, "range")
            .sortWithinPartitions("range", F.desc("context"), "pos", "role", "text").select("conv_id", "range", "context", "role", "text")
            .mapInArrow(rendered(template, window, starts), ROW))


def whole(rows: DataFrame, template: Template, window: int) -> DataFrame:
    """Pieces of ordinary conversations, each in one task."""
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", F.lit(-1).alias("range"), F.lit(False).alias("context"), "role", "text")
            .mapInArrow(rendered(template, window, {}), ROW))


def formatted(conversations: DataFrame, template: Template = marked, window: int = WINDOW) -> DataFrame:
    """``conv_id, seq, role, piece, text_begin, text_end`` for each turn, seq counting from 0.

    A conversation's formatted text is its pieces one after another. Turns are ordered by turn (null first), then role and text;
    rows that repeat are turns of their own. Null roles and texts are empty; rows without conv_id are one conversation. piece and
    the places are null for a turn at which the template rewrites history. No rows give no rows; other columns are not read.
    """
    parts = partitions(conversations.sparkSession)
    short, long = parted(turns_of(conversations), parts) if getattr(template, "local", False) else (turns_of(conversations), None)
    made = whole(short, template, window)
    return made if long is None else made.unionByName(ranged(long, template, window, parts))


def digested(trained: str):
    """One row per conversation, read back from the pieces: turns by the template's marks, trained text by the places found."""
    def rows(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def table(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    def make(batches):
        out = []
        for conv, turns in groupby(rows(batches), key=lambda r: r[0]):
            n = chars = loss_chars = 0
            whole, loss, rewritten = hashlib.sha256(), hashlib.sha256(), False
            for _, _, role, piece, begin, end in turns:
                if piece is None:
                    rewritten = True
                    continue
                chars += len(piece)
                for read_role, text in read(piece):
                    n += 1
                    whole.update(f"{read_role}\n{text}\n".encode())
                if role == trained:
                    text = unescape(piece[begin:end])
                    loss_chars += len(text)
                    loss.update(text.encode())
            out.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars, rewritten))
            if len(out) >= 4096:
                yield table(out)
                out = []
        yield table(out)
    return make


def digests(conversations: DataFrame, template: Template = marked, window: int = WINDOW, trained: str = "assistant") -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten`` for each conversation, read back
    from its pieces; the loss mask covers the texts of the role ``trained``. For the rest see ``formatted``.

    A digest is sequential: the pieces of a conversation that was cut into ranges stream through one task once more, in order.
    """
    parts = partitions(conversations.sparkSession)
    short, long = parted(turns_of(conversations), parts) if getattr(template, "local", False) else (turns_of(conversations), None)
    made = whole(short, template, window).mapInArrow(digested(trained), DIGEST)
    if long is None:
        return made
    again = ranged(long, template, window, parts).repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return made.unionByName(again.mapInArrow(digested(trained), DIGEST))
