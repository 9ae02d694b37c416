"""Chat formatting with a grammar round trip.

Grammar of a rendered turn (everything outside the quotes is literal text of the turn, or its role):

    user       "[INST] " text " [/INST]"
    system     "[SYS] " text " [/SYS]"
    assistant  "<s> " text "</s>"
    others     "[ROLE] " role " [/ROLE] " text "</s>"

A turn is rendered as it is, parsed again and compared; while the recovered turn differs, its conflicting content is
escaped. Control strings inside a text get a backslash after their first character, those that have backslashes there
one more; the parser takes one away, so that escaping is reversible whatever the text says. A formatted conversation is
the concatenation of its turns. Turns are rendered and checked apart from each other, so a huge conversation is
spread over all tasks; only reading back its digest, which is sequential by definition, streams it in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPENING = {"user": "[INST] ", "system": "[SYS] ", "assistant": "<s> "}
CLOSING = {"user": " [/INST]", "system": " [/SYS]", "assistant": "</s>"}
NAMED, NAME_END = "[ROLE] ", " [/ROLE] "
CONTROL = r"/?(?:s>|INST\]|SYS\]|ROLE\])"
_ESCAPE = re.compile(rf"([<\[])(\\*{CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*{CONTROL})")


class GrammarError(ValueError):
    """The input is not a sequence of rendered turns."""


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _parse_at(text: str, at: int) -> tuple[str, int, int, int]:
    """The turn that starts at `at`: its role, where its text starts and ends, where the turn ends."""
    for known, opening in OPENING.items():
        if text.startswith(opening, at):
            role, start, closing = known, at + len(opening), CLOSING[known]
            break
    else:
        name_end = text.find(NAME_END, at)
        if not text.startswith(NAMED, at) or name_end < at + len(NAMED):
            raise GrammarError(f"no turn at {at}")
        role, start, closing = unescape(text[at + len(NAMED) : name_end]), name_end + len(NAME_END), "</s>"
    end = text.find(closing, start)
    if end < 0:
        raise GrammarError(f"turn at {at} does not end")
    return role, start, end, end + len(closing)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        role, start, end, at = _parse_at(formatted, at)
        turns.append((role, unescape(formatted[start:end])))
    return turns


def _rendered(role: str, text: str) -> tuple[str, int, int]:
    opening = OPENING.get(role) or f"{NAMED}{role}{NAME_END}"
    return f"{opening}{text}{CLOSING.get(role, '</s>')}", len(opening), len(opening) + len(text)


def _survives(piece: str, role: str, text: str) -> bool:
    """True if the piece reads as this one turn, and leaves nothing over that could reach into the next."""
    try:
        return parse(piece) == [(role, text)]
    except GrammarError:
        return False


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """A turn, where its text starts and ends in it, and the rounds of escaping that it took."""
    for rounds, (r, t) in enumerate(((role, text), (role, escape(text)), (escape(role), escape(text)))):
        piece, start, end = _rendered(r if role not in OPENING else role, t)
        if _survives(piece, role, text):
            return piece, start, end, rounds
    raise GrammarError(f"turn of role {role[:40]!r} cannot be written")


def format_turns(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, turn, role, segment, text_start, text_end, loss, rounds.

    The segments of a conversation in the order of (turn, role, segment), nulls first, are its formatted text.
    `loss` marks assistant turns: the characters from text_start to text_end train the model. Null roles and texts
    are empty; a null conv_id is a conversation of its own, a null turn comes first. Repeated rows are repeated turns,
    and tied turns are ordered by role and segment. Other columns are not read.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
        ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_()), ("rounds", pa.int32()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                roles = batch.column("role").to_pylist()
                made = [render(r, t) for r, t in zip(roles, batch.column("text").to_pylist(), strict=True)]
                segments, starts, ends, rounds = zip(*made, strict=True) if made else ((), (), (), ())
                columns = [batch.column("conv_id"), batch.column("turn"), roles, segments, starts, ends, [r == "assistant" for r in roles], rounds]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "conv_id long, turn long, role string, segment string, text_start int, text_end int, loss boolean, rounds int")


class _Reader:
    """Parses the segments of one conversation in order, keeping digests and counts only."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, loss: bool, start: int, end: int) -> None:
        for role, text in parse(segment):
            self.turns += 1
            self.digest.update(f"{role}\n{text}\n".encode())
        self.chars += len(segment)
        if loss:
            target = unescape(segment[start:end])
            self.loss_chars += len(target)
            self.loss.update(target.encode())

    def row(self) -> tuple:
        return self.turns, self.digest.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the output of `format_turns`: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments meet their conversation in a shuffle, are sorted outside memory and stream through the parser, so a
    conversation of any length needs the memory of one turn.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, reader, done = nothing, _Reader(), []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "text_start", "text_end")]
            for conv, segment, loss, start, end in zip(*columns, strict=True):
                if conv != current:
                    if current is not nothing:
                        done.append((current, *reader.row()))
                    current, reader = conv, _Reader()
                reader.feed(segment, loss, start, end)
            yield out()
            done.clear()
        if current is not nothing:
            done.append((current, *reader.row()))
            yield out()

    ordered = (
        formatted.select("conv_id", "turn", "role", "segment", "loss", "text_start", "text_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "segment")
    )
    return ordered.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
