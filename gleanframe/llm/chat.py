"""Chat formatting: a state machine over roles, a declarative template, and loss flags by segment.

A template says how each role opens a turn, how a turn ends, which roles are learned from, and
which role may follow which. Texts are escaped so that no control string of the template occurs
inside them; the escape is undone on reading back. Turns are escaped and joined in column
expressions; the state machine and the offsets walk through each conversation in turn order as
a stream, so a conversation may have any number of turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

START, INVALID = "start", "invalid"


@dataclass(frozen=True)
class Template:
    """``opening`` by role; other roles open with ``other``, their name escaped in it.

    ``follows`` maps a state (the last role, or ``start``) to the roles allowed next.
    """

    opening: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
    )
    other: tuple[str, str] = ("### [", "]: ")
    ending: str = " </turn>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            START: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})
    escape: str = "\\"
    # What must not occur inside a text; at least two characters each, none begins with another's rest.
    control: tuple[str, ...] = ("###", "</turn>", "]: ")

    def step(self, state: str, role: str) -> str:
        return role if role in self.follows.get(state, ()) else INVALID


def escaped(text: Column, t: Template) -> Column:
    """The escape character is doubled, and one is put inside every control string."""
    slash = re.escape(t.escape)
    out = F.regexp_replace(text, slash, re.sub(r"([\\$])", r"\\\1", t.escape * 2))
    for control in t.control:
        inside = re.sub(r"([\\$])", r"\\\1", control[0] + t.escape + control[1:])
        # A run such as ##### holds overlapping ones: all but its first character get one.
        if len(set(control)) == 1:
            out = F.regexp_replace(out, f"(?<={re.escape(control[0])}){re.escape(control[0])}", re.sub(r"([\\$])", r"\\\1", t.escape + control[0]))
        else:
            out = F.regexp_replace(out, re.escape(control), inside)
    return out


def unescaped(text: str, t: Template) -> str:
    return re.sub(re.escape(t.escape) + r"(.)", r"\1", text, flags=re.S)


_TURN = "conv_id long, position long, role string, state string, valid boolean, formatted string, loss_start long, loss_end long"


def _walk(t: Template):
    """States, and offsets of the texts that are learned from, along each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, valid, position, offset = object(), START, True, 0, 0
        for batch in batches:
            rows = []
            for c, role, head, body, formatted in zip(
                *(batch.column(x).to_pylist() for x in ("conv_id", "role", "head", "body", "formatted"))
            ):
                if c != conv:
                    conv, state, valid, position, offset = c, START, True, 0, 0
                state = t.step(state, role)
                valid = valid and state != INVALID
                low = offset + head if role in t.learned else None
                rows.append((c, position, role, state, valid, formatted, low, None if low is None else low + body))
                position += 1
                offset += len(formatted)
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds)],
                names=["conv_id", "position", "role", "state", "valid", "formatted", "loss_start", "loss_end"],
            )

    return run


def format_chat(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """One row per turn, each conversation's rows together and in order within a partition.

    ``turns`` has conv_id, turn, role and text. The formatted conversation is its ``formatted``
    columns one after another; ``loss_start`` and ``loss_end`` are code points of it under the
    loss mask (null: none). ``state`` is the machine's state after the turn, ``valid`` whether
    all turns so far were in order. Null roles and texts read as empty; an unknown or repeated
    role makes the state invalid but is formatted all the same. Turns that tie are ordered by
    role, then text, and repeated rows are all kept. A null conv_id is a conversation of its own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    opening = F.concat(F.lit(t.other[0]), escaped(role, t), F.lit(t.other[1]))
    for name, mark in t.opening.items():
        opening = F.when(role == name, F.lit(mark)).otherwise(opening)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), opening.alias("mark"), escaped(text, t).alias("safe")
    ).select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.length("mark").alias("head"),
        F.length("safe").alias("body"),
        F.concat("mark", "safe", F.lit(t.ending)).alias("formatted"),
    )
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "head", "body", "formatted")
        .mapInArrow(_walk(t), _TURN)
    )


class Reader:
    """Reads one formatted conversation back from its pieces, wherever they were cut."""

    def __init__(self, t: Template):
        self.t, self.rest, self.turns, self.length = t, "", 0, 0
        self.all, self.lost, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0

    def feed(self, piece: str) -> None:
        self.length += len(piece)
        self.rest += piece
        while (end := self.rest.find(self.t.ending)) >= 0:
            self._turn(self.rest[:end])
            self.rest = self.rest[end + len(self.t.ending) :]

    def mask(self, piece: str, offset: int, start: int | None, end: int | None) -> None:
        """The part of a piece under the loss mask; ``offset`` is where the piece begins."""
        if start is not None:
            under = unescaped(piece[start - offset : end - offset], self.t)
            self.loss_chars += len(under)
            self.lost.update(under.encode("utf-8", "surrogatepass"))

    def _turn(self, text: str) -> None:
        role = body = None
        for name, mark in self.t.opening.items():
            if text.startswith(mark):
                role, body = name, text[len(mark) :]
        if role is None:
            name, _, body = text[len(self.t.other[0]) :].partition(self.t.other[1])
            role = unescaped(name, self.t)
        self.turns += 1
        self.all.update(f"{role}\n{unescaped(body, self.t)}\n".encode("utf-8", "surrogatepass"))


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _read(t: Template):
    def result(conv: int | None, r: Reader, valid: bool) -> tuple:
        return conv, r.turns, r.all.hexdigest(), r.loss_chars, r.lost.hexdigest(), r.length, valid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, valid = None, None, True
        for batch in batches:
            rows = []
            for c, state, ok, piece, start, end in zip(
                *(batch.column(x).to_pylist() for x in ("conv_id", "state", "valid", "formatted", "loss_start", "loss_end"))
            ):
                if reader is None or c != conv:
                    if reader is not None:
                        rows.append(result(conv, reader, valid))
                    conv, reader = c, Reader(t)
                reader.mask(piece, reader.length, start, end)
                reader.feed(piece)
                valid = ok and state in t.final
            yield _read_batch(rows)
        if reader is not None:
            yield _read_batch([result(conv, reader, valid)])

    return run


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)


def read_back(formatted: DataFrame, t: Template = Template()) -> DataFrame:
    """What the formatted conversations say: turns, their digest, and the text under the loss mask.

    ``formatted`` comes straight from ``format_chat`` (its order within partitions is used), or
    is sorted the same way. Digests are of UTF-8; ``valid`` also asks for an allowed last role.
    """
    return formatted.select("conv_id", "state", "valid", "formatted", "loss_start", "loss_end").mapInArrow(_read(t), _READ)
