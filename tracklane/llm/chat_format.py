"""Conversations as training text: rendered by a template of which nothing is known but its output.

A template is any function from a list of (role, text) to a string. It is given the
first turn, the first two, and so on; each output must begin with the one before,
and what is new is the turn's span. A turn that is learnt from is rendered once more
with a mark that occurs nowhere else in place of its text, which shows where the text
stands inside the span, whatever surrounds or escapes it. Where an output does
not begin with the one before, the template rewrites history: the conversation is then
rendered once, as a whole, and only the turns before the first difference keep their spans.

A template can say by an attribute `context` on how many turns before a turn its
rendering depends at most, and that later ones don't change it (`TurnTemplate`: 0). Then a conversation is cut into
parts of `SEGMENT` turns that several tasks render, each behind the turns before it that matter. Of a template
that says nothing, anything is to be expected: a conversation of any length is rendered whole, as one part, by one task,
in a time that grows with the square of its turns. Turns get their places without a task that sees a whole conversation.

Edge cases: null texts and roles count as empty; a null conversation id is a
conversation of its own; equal turn numbers, nulls first, stand in the order of role and text, and
repeated rows beside each other; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._places import placed
from ._scratch import Scratch

#: Turns of a part, and those before it that its task gets, or more where the template's `context` is.
SEGMENT, CONTEXT = 512, 32
#: Characters of a prefix from which on a segment starts anew behind its last turns, where the template has a `context`.
LONG = 4_000_000
Template = Callable[[list[tuple[str, str]]], str]


class TurnTemplate:
    """`### role: text</turn>` for each turn; backslashes, and what begins a control string in a text or ends a role, are escaped by a backslash."""

    context = 0
    _in_text = re.compile(r"[\\]|#(?=##)|<(?=/turn>)")
    _in_role = re.compile(r"[\\:]")
    _turn = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
    _escaped = re.compile(r"\\(.)", re.DOTALL)

    def __call__(self, turns: list[tuple[str, str]]) -> str:
        return "".join(f"### {self._in_role.sub(r'\\\g<0>', role)}: {self.escape(text)}</turn>\n" for role, text in turns)

    def escape(self, text: str) -> str:
        return self._in_text.sub(r"\\\g<0>", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of an output."""
        out, at = [], 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at character {at}")
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return out


def _mark(*texts: str) -> str:
    """A short string that occurs in none of the texts."""
    k = 0
    while True:
        found = f"{k}"
        if not any(found in t for t in texts):
            return found
        k += 1


def _reach(template: Template) -> int | None:
    """How many turns before a turn are enough to render it; None: all."""
    context = getattr(template, "context", None)
    return None if context is None else max(CONTEXT, context)


class Segment:
    """The rendered turns of a segment: `text` and for each turn (role, start, end, text start, text end), places as None where they can't be told."""

    def __init__(self, template: Template, context: list[tuple[str, str]], turns: list[tuple[str, str]], learn: tuple[str, ...]):
        before, self.pieces, self.turns, self.rewritten_from = list(context), [], [], None
        prefix, length = template(before) if before else "", 0
        start, reach = len(prefix), _reach(template)
        for k, (role, text) in enumerate(turns):
            if reach is not None and len(prefix) > LONG and len(before) > reach:
                before = before[len(before) - reach :]
                prefix = template(before) if before else ""
            now = template([*before, (role, text)])
            if not now.startswith(prefix):
                if reach is not None:
                    raise ValueError(f"the template changes the turns before one, against its context of {template.context}")
                self._whole(template, context, turns, k, start)
                return
            piece = now[len(prefix) :]
            inner = self._inner(template, before, role, prefix, piece, now) if role in learn else (None, None)
            self.turns.append((role, length, length + len(piece), *(None if p is None else length + p for p in inner)))
            self.pieces.append(piece)
            length += len(piece)
            before.append((role, text))
            prefix = now

    @staticmethod
    def _inner(template, before, role, prefix, piece, now):
        mark = _mark(now)
        probe = template([*before, (role, mark)])
        if not probe.startswith(prefix) or probe.count(mark) != 1:
            return None, None
        head, tail = probe[len(prefix) :].split(mark)
        if not (piece.startswith(head) and piece.endswith(tail) and len(piece) >= len(head) + len(tail)):
            return None, None
        return len(head), len(piece) - len(tail)

    def _whole(self, template, context, turns, k, start):
        """The whole segment as the template has it in the end; turns keep their places up to the first difference."""
        whole = template([*context, *turns])[start:]
        same = len(os.path.commonprefix(["".join(self.pieces), whole]))
        kept = [t for t in self.turns if t[2] <= same]
        self.rewritten_from = len(kept)
        self.turns = kept + [(role, None, None, None, None) for role, _ in turns[len(kept) :]]
        self.pieces = [whole]


_TURN = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64())])
_PARTS = "conv_id bigint, part bigint, formatted string, turns array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint>>, rewritten_from int"


def _runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], fields: tuple[str, ...]):
    """(key, rows) of each run of equal keys over all batches of a sorted task, rows as a generator in order."""
    def rows():
        for b in batches:
            yield from zip(zip(*(b[k].to_pylist() for k in keys), strict=True), zip(*(b[f].to_pylist() for f in fields), strict=True), strict=True)

    stream = rows()
    ahead = next(stream, None)
    while ahead is not None:
        key = ahead[0]

        def run(key=key):
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                row, ahead = ahead[1], next(stream, None)
                yield row

        mine = run()
        yield key, mine
        for _ in mine:  # what was not read
            pass


def format_conversations(rows: DataFrame, template: Template | None = None, learn: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, formatted, turns, rewritten_from: a conversation's output in parts of up to SEGMENT turns, or as one part if the template has no `context`.

    `turns` has each turn's role, its span and, for roles in `learn`, its text's span, the loss mask; spans are code points of the part. `rewritten_from`
    is the first turn of the part whose place the template's later outputs changed, null if there is none.
    """
    template = template or TurnTemplate()
    scratch = Scratch(rows.sparkSession, "chat")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = rows.select(F.coalesce(F.concat(F.lit("+"), F.col(conv_col).cast("string")), F.lit("")).alias("g"), F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns, _ = placed(read, ["turn", "role", "text"], scratch, "turns", 1 << 20)
    reach, size = _reach(template), SEGMENT
    own = F.expr(f"place div {size}")
    if reach is None:
        also = F.array(F.lit(0).cast("bigint"))
    else:  # its own part, and the later ones that it stands before
        also = F.sequence(own, F.least(F.expr(f"(place + {reach}) div {size}"), F.expr(f"(total - 1) div {size}")))
    cut = turns.select("g", "conv_id", "role", "text", "place", F.explode(also).alias("segment")).repartition("g", "segment").sortWithinPartitions("g", "segment", "place")

    def render(batches):
        out = []
        for (_, segment, conv), run in _runs(batches, ("g", "segment", "conv_id"), ("role", "text", "place")):
            context, mine = [], []
            for role, said, place in run:
                (mine if reach is None or place // size == segment else context).append((role, said))
            s = Segment(template, context, mine, learn)
            out.append((conv, segment, "".join(s.pieces), [dict(zip(("role", "start", "end", "text_start", "text_end"), t, strict=True)) for t in s.turns], s.rewritten_from))
            if len(out) >= 500 or len(out[-1][2]) > 1 << 20:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out):
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(_TURN), pa.int32()), strict=True)], ["conv_id", "part", "formatted", "turns", "rewritten_from"])

    return cut.mapInArrow(render, _PARTS)


def read_back(parts: DataFrame, template: TurnTemplate | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what can be read from the formatted parts alone, a conversation's in their order.

    Digests follow one another, so a conversation is read by one task, which holds one part at a time.
    """
    template = template or TurnTemplate()

    def digest(batches):
        out = []
        for (conv,), run in _runs(batches, ("conv_id",), ("formatted", "turns")):
            said, learnt, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for formatted, turns in run:
                for role, text in template.read(formatted):
                    said.update(f"{role}\n{text}\n".encode())
                    n += 1
                for t in turns:
                    if t["text_start"] is not None:
                        text = template.unescape(formatted[t["text_start"] : t["text_end"]])
                        learnt.update(text.encode())
                        chars += len(text)
                size += len(formatted)
            out.append((conv, n, said.hexdigest(), chars, learnt.hexdigest(), size))
            if len(out) >= 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
