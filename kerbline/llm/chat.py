"""Chat formatting by incremental rendering of a black-box template.

The template is any function from turns (role, text) to a string. Prefixes of one turn more each are rendered; what a
rendering adds to the one before is the turn's span, and where a rendering doesn't begin with the one before, the
template rewrites history: the conversation is flagged and its spans are taken as far as renderings agree with the
last one. Where in its span a turn's text stands is told by rendering the prefix with a sign in its place, a word that no
turn holds: what stands before and after the sign is the template's. A span says whether its text was located so, and
whether it stands there as it is (verbatim) or escaped. The loss mask covers the texts of assistant turns.

Rendering every prefix costs the square of the turns. A template that is a start and a rendering of each turn may say so
(its attribute each); conversations of over LONG turns are then rendered turn by turn, and the whole rendering proves it.

The own template marks turns and escapes its control signs in roles and texts reversibly, so parse() gets them back.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role and text, so repeated
rows are turns of their own; a row without conv_id is a conversation of its own; an empty table gives an empty result; a text
that the template drops, changes or repeats is not located and its place is the end of its span; a long conversation is
one row, rendered by the task that holds it; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shards

Turns = list[tuple[str, str]]
LOSS_ROLE = "assistant"
LONG = 200


def escape(text: str) -> str:
    return re.sub(r"[\\#<]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: Turns) -> str:
    """'### role: text</turn>' and a line's end for each turn."""
    return "".join(map(_turn, turns))


def _turn(turn: tuple[str, str]) -> str:
    return f"### {escape(turn[0]).replace(':', chr(92) + ':')}: {escape(turn[1])}</turn>\n"


render.each = _turn


_TURN = re.compile(r"### ((?:\\.|[^\\#<:])*): ((?:\\.|[^\\#<])*)</turn>\n", re.S)


def parse(text: str) -> Turns:
    """The turns of what render made."""
    out, at = [], 0
    while at < len(text):
        if not (m := _TURN.match(text, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


Span = tuple[int, int, int, int, bool, bool]


def _sign(turns: Turns) -> str:
    """Letters that no turn holds."""
    k, all_ = 0, "\n".join(x for turn in turns for x in turn)
    while (sign := "qz" + "x" * k + "zq") in all_:
        k += 1
    return sign


def _place(made: str, probe: str, sign: str) -> tuple[int, int] | None:
    """Where in a rendering the text stands that the sign takes the place of in the other."""
    at = probe.find(sign)
    after = probe[at + len(sign) :]
    if at < 0 or sign in after or made[:at] != probe[:at] or len(made) < at + len(after) or not made.endswith(after):
        return None
    return at, len(made) - len(after)


def located(turns: Turns, template: Callable[[Turns], str] = render) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(rendering, (start, end, text start, text end) of each turn, whether history is rewritten)."""
    text, spans, rewritten = placed(turns, template)
    return text, [x[:4] for x in spans], rewritten


def placed(turns: Turns, template: Callable[[Turns], str] = render) -> tuple[str, list[Span], bool]:
    """As located, and of each turn whether its text was located, and whether it stands there verbatim."""
    whole, before, sign = template(turns), template([]), _sign(turns)
    each = getattr(template, "each", None)
    if each and len(turns) > LONG and (out := _added(turns, whole, before, each, sign)):
        return whole, out, False
    spans, rewritten = [], False
    for k, (role, text) in enumerate(turns):
        now = whole if k + 1 == len(turns) else template(turns[: k + 1])
        if not now.startswith(before):
            rewritten = True
        start, end = (len(before), len(now)) if not rewritten and whole.startswith(now) else (_common(before, whole), _common(now, whole))
        rewritten = rewritten or not whole.startswith(now)
        start = min(start, end)
        place = _place(now, template([*turns[:k], (role, sign)]), sign)
        if place and start <= place[0] and place[1] <= end:
            spans.append((start, end, *place, True, whole[place[0] : place[1]] == text))
        else:
            spans.append((start, end, end, end, False, False))
        before = now
    return whole, spans, rewritten


def _added(turns: Turns, whole: str, before: str, each: Callable[[tuple[str, str]], str], sign: str) -> list[Span] | None:
    """The spans of a rendering that is the start and each turn's own; None if it isn't."""
    made = [each(turn) for turn in turns]
    if before + "".join(made) != whole:
        return None
    spans, start = [], len(before)
    for (role, text), own in zip(turns, made, strict=True):
        end, place = start + len(own), _place(own, each((role, sign)), sign)
        if place:
            spans.append((start, end, start + place[0], start + place[1], True, own[place[0] : place[1]] == text))
        else:
            spans.append((start, end, end, end, False, False))
        start = end
    return spans


SCHEMA = "conv_id long, n_turns long, formatted string, rewritten boolean, spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long,located:boolean,verbatim:boolean>>"
_SPAN = pa.struct([("role", pa.string()), *((x, pa.int64()) for x in ("start", "end", "text_start", "text_end")), ("located", pa.bool_()), ("verbatim", pa.bool_())])
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("rewritten", pa.bool_()), ("spans", pa.list_(_SPAN))])


def _format(batches: Iterator[pa.RecordBatch], template: Callable[[Turns], str]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation."""
    key, turns, rows, size = object(), [], [], 0

    def done() -> dict:
        text, spans, rewritten = placed(turns, template)
        return {"conv_id": key, "n_turns": len(turns), "formatted": text, "rewritten": rewritten, "spans": [dict(zip(_SPAN.names, (role, *span), strict=True)) for (role, _), span in zip(turns, spans, strict=True)]}

    for batch in batches:
        for k, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if turns and (k is None or k != key):
                rows.append(done())
                size += len(rows[-1]["formatted"])
                turns = []
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
            key = k
            turns.append((role, text))
    if turns:
        rows.append(done())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def format_conversations(rows: DataFrame, template: Callable[[Turns], str] = render, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation, in columns of SCHEMA; places are characters of formatted."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = rows.select(F.col(id_col).cast("long").alias("k"), text(role_col).alias("role"), text(text_col).alias("text"), F.col(turn_col).alias("turn"))
    dealt = own.repartition(shards(own), F.coalesce("k", F.xxhash64("turn", "role", "text"))).sortWithinPartitions("k", "turn", "role", "text")
    return dealt.select("k", "role", "text").mapInArrow(partial(_format, template=template), SCHEMA)
