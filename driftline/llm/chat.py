"""Chat formatting by incremental rendering of a template that is a black box.

A template is a function from a list of turns (role, text) to one string; nothing else of it
is known.  A conversation's turns are rendered as successive prefixes:

1. The rendering of the first k turns is compared with that of the first k - 1.  If it begins
   with it, what follows is turn k's span.  If not, the template rewrites history: the step is
   reported, and the spans before the first changed character alone stay as they were.
2. Where a turn's text stands in its span is found by two more renderings of the same prefix,
   with the turn's text empty and with a mark that the first doesn't hold: they differ first
   where the text begins, and the lengths tell where it ends.
3. Assistant texts are under the loss mask.

Rows are dealt by conversation, sorted by turn within partitions and streamed.  A conversation
of more than TURNS turns or CHARS characters is rendered in parts: a later part begins after a
rendering of the turn before it, so that rendering takes time in proportion to the length, and a
task holds one part, whatever the conversation's length.  That is right for templates in
which a turn's own output depends on the turn before it and on its being the first, which
`agrees` checks for given turns; shorter conversations are rendered from their first turn.
A digest over a conversation has to see its parts one after the other, so a conversation is
one task's stream; nothing of it is collected.

The own template, `chatml`, writes <|im_start|>role, a new line, the text, <|im_end|> and a
new line.  In roles and texts every `<` that is followed by backslashes and `|` gets one more
backslash, so that no control string can stand inside, and `plain` takes it away again.  In
roles, backslashes and new lines are escaped first.

Defined cases: a null text is an empty one, a null role an empty role; a conversation of null
id is one like any other; rows of equal turn, null turns first, follow each other by role, then
text, repeated rows one for each; gaps between turn numbers don't matter; very long texts are
taken whole; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Turns and characters of one part of a conversation.
TURNS, CHARS = 256, 1 << 20
START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
#: Characters of formatted parts in one batch.
HELD = 4 << 20

Turn = tuple[str, str]
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def plain(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def chatml(turns: list[Turn]) -> str:
    """The own template."""
    return "".join(f"{START}{escaped(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{escaped(text)}{END}\n" for role, text in turns)


def read_chatml(formatted: str) -> list[Turn]:
    """The turns that chatml has written; ValueError if anything else stands there."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], plain(m[1]))
        out.append((role, plain(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


def _mark(held: str) -> str:
    """A character that the string doesn't hold."""
    return next(c for c in map(chr, range(0xE000, 0xF900)) if c not in held)


def _differ(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def locate(render: Callable[[list[Turn]], str], turns: list[Turn], before: list[Turn] = []) -> tuple[str, list[tuple], list[int]]:
    """(output, (start, end, text_start, text_end) of each turn, steps at which history was rewritten).

    `before` are turns that stand before these ones; their output isn't part of what is returned.
    A turn's text is where its empty and its marked renderings differ, unless the template changes
    the text's length by its content; text_start and text_end are then null.  Spans that a later
    step has changed are null.
    """
    base = last = render(before) if before else ""
    spans, rewrites, prefix = [], [], list(before)
    for k, turn in enumerate(turns):
        prefix.append(turn)
        out = render(prefix)
        start = len(last)
        if not out.startswith(last):
            rewrites.append(k)
            start = _differ(last, out)
            spans = [s if s and s[1] <= start else None for s in spans]
        prefix[-1] = (turn[0], "")
        empty = render(prefix)
        prefix[-1] = (turn[0], _mark(empty + out))
        a = _differ(empty, render(prefix))
        b = a + len(out) - len(empty)
        prefix[-1] = turn
        found = start <= a <= b <= len(out) and out[:a] == empty[:a] and out[b:] == empty[a:]
        # after a rewrite nothing tells the turn's own output from what was changed, but for its text
        spans.append((start if k not in rewrites else a if found else start, len(out), a if found else None, b if found else None))
        last = out
    cut = len(base)
    if not last.startswith(base):
        cut = 0
        rewrites = rewrites or [0]
    moved = [tuple(x if x is None else x - cut for x in s) if s else (None,) * 4 for s in spans]
    return last[cut:], moved, rewrites


def agrees(render: Callable[[list[Turn]], str], turns: list[Turn], size: int = TURNS) -> bool:
    """Whether parts of so many turns, each after one turn before it, give the output of the whole."""
    parts = [locate(render, turns[a : a + size], turns[max(0, a - 1) : a])[0] for a in range(0, len(turns), size)]
    return "".join(parts) == render(turns)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))


def _parts(rows: Iterator[tuple[object, str, str]], turns: int, chars: int) -> Iterator[tuple[object, int, list[Turn], list[Turn]]]:
    """(conversation, number of the part, turn before it, turns)."""
    now, part, size, before, held = None, 0, 0, [], []
    for conv, role, text in rows:
        if held and conv != now:
            yield now, part, before, held
            part, size, before, held = 0, 0, [], []
        elif held and (len(held) >= turns or size + len(text) > chars):
            yield now, part, before, held
            part, size, before, held = part + 1, 0, held[-1:], []
        now = conv
        held.append((role, text))
        size += len(text)
    if held:
        yield now, part, before, held


def formatted(rows: DataFrame, render: Callable[[list[Turn]], str] = chatml, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns: int = TURNS, chars: int = CHARS) -> DataFrame:
    """conv_id, part int, formatted, spans array<struct<start, end, text_start, text_end, loss>>, rewrites array<int>.

    Spans are in code points of the part; a conversation's parts follow each other, part 0 first,
    in one partition.
    """
    src = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    dealt = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    names = ["conv_id", "part", "formatted", "spans", "rewrites"]

    def run(batches):
        kinds = []

        def rows_of():
            for batch in batches:
                kinds[:] = [batch.schema.field("conv_id").type]
                for c, r, t in zip(*batch.columns):
                    yield c.as_py(), r.as_py(), t.as_py()

        out, size = [], 0
        for conv, part, before, held in _parts(rows_of(), turns, chars):
            text, spans, rewrites = locate(render, held, before)
            where = [dict(zip(("start", "end", "text_start", "text_end"), s)) | {"loss": r == LEARNED} for s, (r, _) in zip(spans, held)]
            out.append((conv, part, text, where, rewrites))
            size += len(text)
            if size >= HELD:
                yield _batch(out, kinds[0], names)
                out, size = [], 0
        if out:
            yield _batch(out, kinds[0], names)

    kind = dict(src.dtypes)["conv_id"]
    return dealt.mapInArrow(run, f"conv_id {kind}, part int, formatted string, spans array<struct<start:long,end:long,text_start:long,text_end:long,loss:boolean>>, rewrites array<int>")


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, pa.int32(), pa.string(), SPANS, pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def digests(parts: DataFrame, read: Callable[[str], list[Turn]] = read_chatml, unescape: Callable[[str], str] = plain) -> DataFrame:
    """conv_id and digests of what the formatted parts hold, read from them alone; parts as `formatted` gives them."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]

    def run(batches):
        kind, rows, now, state = None, [], None, None

        def end():
            conv, n, turns, chars, loss, size, rewrites = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, p, f, s, r in zip(*batch.columns):
                conv, text = c.as_py(), f.as_py()
                if p.as_py() == 0:
                    if state:
                        end()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for x in s.as_py():
                    if x["loss"] and x["text_start"] is not None:
                        said = unescape(text[x["text_start"] : x["text_end"]])
                        state[3] += len(said)
                        state[4].update(said.encode())
                state[5] += len(text)
                state[6] += len(r)
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], names=names)
                rows.clear()
        if state:
            end()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], names=names)

    kind = dict(parts.dtypes)["conv_id"]
    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, which says control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{END}{START}{LEARNED} ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, LEARNED, said)], "conv_id long, turn long, role string, text string")
    return digests(formatted(rows.union(own)))
