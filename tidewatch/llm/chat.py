"""Chat formatting with a grammar round trip.

A conversation becomes one text by a template of control strings, and a deterministic parser reads it
back:

    conversation = BEGIN turn*
    turn         = "[INST] " text " [/INST]"            (user)
                 | "[ANS] " text " </s>"                (assistant)
                 | "<<SYS:" role " >> " text " <</SYS>>"  (any other role)

Every turn is rendered, parsed and compared with its source. Where the two differ, the control strings in
its content are escaped with a backslash, then all that looks like one, and it is tried again, until the
parser returns the source exactly. Turns whose text holds nothing of the kind are never changed.

Segments of turns, put one after the other, are the formatted text. They are made and read in
order of the turns by tasks that hold one batch at a time, so a conversation may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import small_batches

BEGIN = "<s>"
_CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS:", ">>", "<</SYS>>")
# A control string with the backslashes before it; longer strings first.
_FOUND = re.compile(r"(\\*)(" + "|".join(re.escape(c) for c in sorted(_CONTROL, key=len, reverse=True)) + ")")
# What looks like one, in any case and with blanks in it.
_LIKE = re.compile(r"(\\*)(<\s*/?\s*s\s*>|\[\s*/?\s*(?:INST|ANS)\s*\]|<<\s*/?\s*SYS\s*:?|>>)", re.IGNORECASE)
_OPEN = {"user": "[INST] ", "assistant": "[ANS] "}
_CLOSE = {"user": " [/INST]", "assistant": " </s>"}


class NotInGrammar(ValueError):
    """The text cannot be derived from the grammar."""


def _escape(text: str, level: int) -> str:
    if level == 0:
        return text
    return (_FOUND if level == 1 else _LIKE).sub(lambda m: "\\" + m.group(0), text)


def _unescape(text: str) -> str:
    return _FOUND.sub(lambda m: m.group(0)[1:] if m.group(1) else m.group(0), text)


def _render(role: str, text: str, level: int) -> str:
    if role in _OPEN:
        return _OPEN[role] + _escape(text, level) + _CLOSE[role]
    return f"<<SYS:{_escape(role, level)} >> {_escape(text, level)} <</SYS>>"


def _content(formatted: str, at: int, close: str) -> tuple[int, int]:
    """Where the content from ``at`` ends, at the first control string that is not escaped; this must be
    ``close``, with its blank before it. And the place after it."""
    mark = close.strip()
    for found in _FOUND.finditer(formatted, at):
        if found.group(1):
            continue
        end = found.end() - len(close)
        if found.group(2) != mark or end < at or formatted[end : found.end()] != close:
            break
        return end, found.end()
    raise NotInGrammar(f"no {mark}")


def parse_turn(formatted: str, at: int = 0) -> tuple[str, str, tuple[int, int], int]:
    """Role and text of the turn at ``at``, the span of its content, and its end."""
    for role, opening in _OPEN.items():
        if formatted.startswith(opening, at):
            start = at + len(opening)
            end, after = _content(formatted, start, _CLOSE[role])
            return role, _unescape(formatted[start:end]), (start, end), after
    if not formatted.startswith("<<SYS:", at):
        raise NotInGrammar("no turn begins here")
    end, after = _content(formatted, at + 6, " >>")
    role = _unescape(formatted[at + 6 : end])
    if formatted[after : after + 1] != " ":
        raise NotInGrammar("no blank after the role")
    start = after + 1
    end, after = _content(formatted, start, " <</SYS>>")
    return role, _unescape(formatted[start:end]), (start, end), after


def render_turn(role: str, text: str) -> str:
    """The segment of one turn, which the parser turns back into the very same role and text."""
    for level in (0, 1, 2):
        segment = _render(role, text, level)
        try:
            found, back, _, end = parse_turn(segment)
        except NotInGrammar:
            continue
        if (found, back, end) == (role, text, len(segment)):
            return segment
    raise NotInGrammar(f"a turn of role {role!r} can't be formatted")


def parse(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """Role, text and content span of the turns of a whole formatted conversation."""
    if not formatted.startswith(BEGIN):
        raise NotInGrammar("no begin")
    turns, at = [], len(BEGIN)
    while at < len(formatted):
        role, text, span, at = parse_turn(formatted, at)
        turns.append((role, text, span))
    return turns


def render(turns: list[tuple[str, str]]) -> str:
    return BEGIN + "".join(render_turn(role, text) for role, text in turns)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, place, segment`` of ``turns`` (``conv_id, turn, role, text``; others are ignored), in order.

    The formatted text of a conversation is its segments by ``place``; the first begins with
    ``BEGIN``. Turns are ordered by turn, then role and text, null first; repeated rows are turns of their own. A null
    text counts as empty, a null role as empty; rows without conv_id are one conversation.
    """
    small_batches(turns.sparkSession)
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*order).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = run  # no conversation
        place = 0
        for batch in batches:
            places, segments = [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                place = place + 1 if conv == last else 0
                last = conv
                places.append(place)
                segments.append((BEGIN if place == 0 else "") + render_turn(role or "", text or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(segments, pa.string())],
                names=["conv_id", "place", "segment"],
            )

    return rows.mapInArrow(run, "conv_id long, place long, segment string")


def whole_texts(segments: DataFrame) -> DataFrame:
    """``conv_id, formatted`` with a conversation in a row; for conversations that fit in one."""
    listed = F.sort_array(F.collect_list(F.struct("place", "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda s: s["segment"]), "").alias("formatted"))


def read_back(segments: DataFrame) -> DataFrame:
    """What the parser finds in the segments of each conversation, which must stand in order as
    ``format_conversations`` leaves them: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``. The loss mask covers the contents of the assistant's turns."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list | None = None

        def closed(state: list) -> dict:
            conv, turns, all_turns, chars, loss, formatted = state
            return dict(zip(names, (conv, turns, all_turns.hexdigest(), chars, loss.hexdigest(), formatted)))

        for batch in batches:
            rows = []
            for conv, place, segment in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "segment"))):
                at = 0
                if place == 0:
                    if current is not None:
                        rows.append(closed(current))
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    if not segment.startswith(BEGIN):
                        raise NotInGrammar("no begin")
                    at = len(BEGIN)
                role, text, span, end = parse_turn(segment, at)
                if end != len(segment):
                    raise NotInGrammar("more than a turn")
                current[1] += 1
                current[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    masked = _unescape(segment[span[0] : span[1]])
                    current[3] += len(masked)
                    current[4].update(masked.encode("utf-8", "surrogatepass"))
                current[5] += len(segment)
            yield pa.RecordBatch.from_pylist(rows, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([closed(current)], schema)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
