"""Chat formatting with a grammar round trip.

    conversation := "<s>" turn*
    turn         := "[INST] " text " [/INST]"            a user's
                  | " " text " </s>"                     an assistant's
                  | "<<SYS>> " text " <</SYS>>"          a system's
                  | "[ROLE] " name "\\n" text " [/ROLE]"   any other role; name in JSON

A text stands as it is wherever that reads back as the same turn. The formatter parses what it
has rendered with the deterministic parser below, compares the recovered turns with the source,
and escapes the texts of those that differ, until all are identical. Escaping puts one more
backslash before each control string and the backslashes in front of it; a control string
behind a backslash is text, and reading takes one backslash away.

Turns are formatted in parts of ``TURNS_PER_PART``, in order, as they stream through a task: a
conversation of any length needs the memory of one part. Loss spans are the places of assistant
texts, in code points of their part.

Defined results: a null text is empty, a null role is a role of its own; turns of one
conversation are ordered by turn, then role, then text, null first, and equal rows stay
separate turns; a null conv_id is one conversation; an empty table gives no parts; other
columns of the input are not carried.
"""

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TURNS_PER_PART = 64
CHARS_PER_PART = 4_000_000

BEGIN = "<s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [/ROLE]")
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]

_ANY = "|".join(map(re.escape, CONTROL))
_ESCAPE = re.compile(rf"\\*(?:{_ANY})")
_UNESCAPE = re.compile(rf"\\(\\*(?:{_ANY}))")
_BARE = re.compile(rf"(?<!\\)(?:{_ANY})")

FORMATTED = "conv_id bigint, part int, n_turns int, formatted string, loss array<struct<start:int,end:int>>"
RECOVERED = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

Turn = tuple[str | None, str]


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _frame(role: str | None) -> tuple[str, str]:
    return MARKS.get(role) or (OTHER[0] + json.dumps(role, ensure_ascii=True) + "\n", OTHER[1])


def parse(formatted: str, begins: bool = True) -> list[Turn]:
    """The turns of a formatted text; ValueError where the grammar does not allow it."""
    at, turns = 0, []
    if begins:
        if not formatted.startswith(BEGIN):
            raise ValueError("no beginning")
        at = len(BEGIN)
    while at < len(formatted):
        role, (opening, closing) = next(
            ((r, m) for r, m in MARKS.items() if formatted.startswith(m[0], at)), ("", OTHER))
        if not formatted.startswith(opening, at):
            raise ValueError(f"no turn begins at {at}")
        start = at + len(opening)
        if opening == OTHER[0]:
            end = formatted.index("\n", start)
            role, start = json.loads(formatted[start:end]), end + 1
        mark = _BARE.search(formatted, start)
        if mark is None or mark[0] != closing[1:] or mark.start() - 1 < start or formatted[mark.start() - 1] != " ":
            raise ValueError(f"the turn at {at} does not end")
        turns.append((role, unescape(formatted[start:mark.start() - 1])))
        at = mark.end()
    return turns


def _recovers(formatted: str, turns: list[Turn], begins: bool) -> bool:
    try:
        return parse(formatted, begins) == turns
    except ValueError:
        return False


def render(turns: list[Turn], begins: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text that reads back as ``turns``, and its loss spans."""
    escaped = [False] * len(turns)
    while True:
        pieces, spans, length = [BEGIN] if begins else [], [], len(BEGIN) if begins else 0
        for (role, text), conflicts in zip(turns, escaped, strict=True):
            opening, closing = _frame(role)
            body = escape(text) if conflicts else text
            if role == "assistant":
                spans.append((length + len(opening), length + len(opening) + len(body)))
            pieces += [opening, body, closing]
            length += len(opening) + len(body) + len(closing)
        formatted = "".join(pieces)
        if _recovers(formatted, turns, begins):
            return formatted, spans
        conflicts = [
            not done and not _recovers(_frame(role)[0] + text + _frame(role)[1], [(role, text)], False)
            for (role, text), done in zip(turns, escaped, strict=True)]
        if not any(conflicts):
            raise ValueError("the grammar cannot carry these turns")
        escaped = [a or b for a, b in zip(escaped, conflicts, strict=True)]


def format_conversations(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Formatted parts of every conversation from rows of conv_id, turn, role, text.

    Parts of one conversation stay in one partition, in order."""
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, held, chars, rows = None, -1, [], 0, []

        def close() -> None:
            formatted, spans = render(held, part == 0)
            rows.append((conv, part, len(held), formatted, spans))

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "role", "text"))
            for conv_id, role, text in zip(*columns, strict=True):
                other = part < 0 or conv_id != conv
                if held and (other or len(held) >= turns_per_part or chars > CHARS_PER_PART):
                    close()
                    held, chars = [], 0
                    part += 1
                if other:
                    conv, part = conv_id, 0
                held.append((role, text or ""))
                chars += len(text or "")
            if sum(len(r[3]) for r in rows) > CHARS_PER_PART:
                yield _parts(rows)
                rows.clear()
        if held:
            close()
        yield _parts(rows)

    return ordered.mapInArrow(run, FORMATTED)


def _parts(rows: list) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.record_batch([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string()),
        pa.array([[{"start": a, "end": b} for a, b in r[4]] for r in rows], pa.list_(span)),
    ], names=["conv_id", "part", "n_turns", "formatted", "loss"])


def read_back(parts: DataFrame) -> DataFrame:
    """One row for each conversation, from its parts alone: digests of the recovered turns and
    of the text under the loss mask. Expects parts as ``format_conversations`` leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, []
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "part", "formatted", "loss"))
            for conv_id, part, formatted, loss in zip(*columns, strict=True):
                if part == 0:
                    if state:
                        rows.append(state)
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted, part == 0):
                    state[1] += 1
                    state[2].update(f"{role or ''}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"]:span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
            yield _digests(rows)
            rows = []
        yield _digests(rows + ([state] if state else []))

    return parts.mapInArrow(run, RECOVERED)


def _digests(rows: list) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2].hexdigest() for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64()),
        pa.array([r[4].hexdigest() for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.int64()),
    ], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
