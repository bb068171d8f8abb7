"""Chat formatting by incremental black-box rendering.

``render(turns, open_reply)`` is any template: a function from a list of (role, text) to one
string, which may leave an assistant's reply open at the end. It is called on every
successive prefix of a conversation; where the output for the longer prefix starts with the
output for the shorter one, the rest is the new turn's span. Where it does not, the template
rewrites history: the conversation is flagged, and no spans and no mask are given, since
places in earlier outputs mean nothing in the last one. The part of a span that is the
turn's text is found by rendering the same turn with two one-character texts and taking away
what both outputs share at either end. Text spans of assistant turns form the loss mask.

A conversation is one output row, so its turns meet in one task; nothing else is grouped. The
calls grow with its turns and each call with the turns it is given, so the work grows with
the square of the turns whatever the template; ``TurnTemplate`` keeps the turns it has
rendered, which leaves a join of strings to repeat. Null roles and texts count as empty;
turns with equal numbers are ordered by role and text; repeated rows are turns of their own;
rows with a null conv_id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_batches

Turn = tuple[str, str]
Render = Callable[[list[Turn], bool], str]

#: Roles that have a heading of their own; others are written out, escaped.
HEADINGS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
END = "</turn>\n"
_SPECIAL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### (?:(System|User|Assistant|Tool)|role=((?:[^\\#<:]|\\.)*)): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    """A backslash before every character that a control string could start or end with."""
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class _Rendered(dict):
    """Turns to what they are rendered as; ``size`` counts the characters held."""

    def __init__(self, one: Callable[[str, str], str]):
        self.one, self.size = one, 0

    def __missing__(self, turn: Turn) -> str:
        said = self[turn] = self.one(*turn)
        self.size += len(said)
        return said


class TurnTemplate:
    """A template that puts its turns one after another; what it has rendered is held up to ``limit`` characters."""

    def __init__(self, one: Callable[[str, str], str], opening: str = "", limit: int = 50_000_000):
        self._one, self._opening, self._limit, self._held = one, opening, limit, _Rendered(one)

    def __call__(self, turns: list[Turn], open_reply: bool = False) -> str:
        if self._held.size > self._limit:
            self._held = _Rendered(self._one)
        return "".join(map(self._held.__getitem__, turns)) + (self._opening if open_reply else "")

    def __reduce__(self):
        return TurnTemplate, (self._one, self._opening, self._limit)


def marked_turn(role: str, text: str) -> str:
    head = f"### {HEADINGS[role]}: " if role in HEADINGS else f"### role={escape(role)}: "
    return head + escape(text) + END


#: The template of this module: ``### Role: text</turn>`` a turn.
marked_turns = TurnTemplate(marked_turn, "### Assistant: ")


def read_back(formatted: str) -> list[Turn]:
    """The turns that ``marked_turns`` has written."""
    names = {v: k for k, v in HEADINGS.items()}
    return [(names[m[1]] if m[1] else unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


def _common_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest equal start, by halving
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _around(before: list[Turn], role: str, at: int, render: Render) -> tuple[int, int]:
    """Characters that the template puts before and after the text of a turn behind ``before``,
    found by rendering two one-character texts that differ."""
    a, b = (render([*before, (role, c)], False)[at:] for c in "\ue000\ue001")
    return _common_start(a, b), _common_start(a[::-1], b[::-1])


def spans(turns: list[Turn], render: Render, masked_role: str = "assistant") -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The output for all turns, each turn's span, the spans of masked text, whether history is rewritten."""
    previous, found, masked, rewrites = render([], False), [], [], False
    for i, (role, _) in enumerate(turns):
        now = render(turns[: i + 1], False)
        if not now.startswith(previous):
            rewrites = True
            found.append((-1, -1))
            previous = now
            continue
        found.append((len(previous), len(now)))
        if role == masked_role:
            head, tail = _around(turns[:i], role, len(previous), render)
            masked.append((len(previous) + head, len(now) - tail))
        previous = now
    if rewrites:  # offsets of earlier prefixes need not hold in the last output
        found, masked = [(-1, -1)] * len(turns), []
    return previous, found, masked, rewrites


_SPANS = "array<struct<start:int,end:int>>"
OUTPUT = f"conv_id long, n_turns long, formatted string, turn_spans {_SPANS}, loss_spans {_SPANS}, rewrites_history boolean"


def format_conversations(rows: DataFrame, render: Render = marked_turns) -> DataFrame:
    """rows: conv_id, turn, role, text; one output row a conversation, spans in code points."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            done = []
            for turns in rb.column("turns"):
                own = [(t["role"].as_py(), t["text"].as_py()) for t in turns]
                done.append((len(own), *spans(own, render)))
            pairs = lambda at: [[{"start": a, "end": b} for a, b in d[at]] for d in done]
            columns = {
                "conv_id": rb.column("conv_id").cast(pa.int64()), "n_turns": pa.array([d[0] for d in done], pa.int64()), "formatted": pa.array([d[1] for d in done], pa.string()),
                "turn_spans": pa.array(pairs(2), span), "loss_spans": pa.array(pairs(3), span), "rewrites_history": pa.array([d[4] for d in done], pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return in_batches(grouped).mapInArrow(run, OUTPUT)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted text: turns, and the text under the loss mask."""
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = []
            for text, loss in zip(rb.column("formatted").to_pylist(), rb.column("loss_spans").to_pylist(), strict=True):
                turns = read_back(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((len(turns), _sha(said), len(under), _sha(under), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([rb.column("conv_id"), *made], names=names)

    return in_batches(formatted).select("conv_id", "formatted", "loss_spans").mapInArrow(run, kind)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
