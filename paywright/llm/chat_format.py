"""Conversations of typed content parts as training text: a reversible template, loss spans, attachments, and reading it back."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A part of a message. Sizes are those of its kind: pixels of an image, seconds of a sound, pages of a document.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
LOSS_ROLES = ("assistant",)
#: Characters after which a formatted conversation goes on in another piece, behind a whole turn.
PIECE_CHARS = 1 << 20

#: The template: ``<turn>`` role ``<say>`` content ``</turn>`` and a line end. Attachments stand as ``<image:0>``.
TURN, SAY, END = "<turn>", "<say>", "</turn>\n"
_NAMES = "/?turn|say|(?:image|audio|document):[0-9]+"
_LIKE_CONTROL = re.compile(rf"<(\\*)({_NAMES})>")
_ESCAPED = re.compile(rf"<\\(\\*)({_NAMES})>")
_CONTROL = re.compile(rf"<({_NAMES})>")


def escape(text: str) -> str:
    r"""Text in which no control string is left: each gets a backslash behind its ``<``, and so does one that has some."""
    return _LIKE_CONTROL.sub(r"<\\\1\2>", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1\2>", text) if "<" in text else text


@dataclass(frozen=True)
class Expansion:
    """Tokens that a model puts in the place of an attachment. One whose size is unknown counts one token."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 512

    def image(self, part: dict) -> int:
        return max(1, math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch))

    def audio(self, part: dict) -> int:
        seconds = part["seconds"] or 0.0
        return max(1, math.ceil(seconds * self.per_second)) if math.isfinite(seconds) else 1

    def document(self, part: dict) -> int:
        return max(1, (part["pages"] or 0) * self.per_page)


@dataclass
class Flattener:
    """Visits the parts of turns in order and writes one text.

    Text parts that stand side by side are escaped as one, so that no control string arises where they meet.
    """

    expansion: Expansion
    loss_roles: tuple[str, ...]
    out: list[str] = field(default_factory=list)
    chars: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    _texts: list[str] = field(default_factory=list)
    _learn: bool = False

    def turn(self, role: str, parts: list[dict | None]) -> None:
        self._learn = role in self.loss_roles
        self._write(f"{TURN}{escape(role)}{SAY}")
        for part in parts:
            if part is not None:
                getattr(self, f"visit_{part['type']}", self.visit_text)(part)
        self._flush()
        self._write(END)

    def visit_text(self, part: dict) -> None:
        """Also parts of no known type, of which only a text counts."""
        if part["text"]:
            self._texts.append(part["text"])

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, self.expansion.image(part))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, self.expansion.audio(part))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.expansion.document(part))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._flush()
        index = len(self.attachments)
        self._write(f"<{kind}:{index}>")
        self.attachments.append((index, kind, part["ref"], tokens))

    def _flush(self) -> None:
        if self._texts:
            written = escape("".join(self._texts))
            if self._learn:
                self.spans.append((self.chars, self.chars + len(written)))
            self._write(written)
            self._texts.clear()

    def _write(self, text: str) -> None:
        self.out.append(text)
        self.chars += len(text)


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its message; null is an empty text."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *empty))


def read_back(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn of a formatted text: ("text", text) or ("image" ..., its index), in order."""
    role, parts, at, inside = "", [], 0, False

    def text(end: int) -> None:
        if end > at:
            parts.append(("text", unescape(formatted[at:end])))

    for mark in _CONTROL.finditer(formatted):
        name = mark[1]
        if name == "turn":
            parts, inside = [], False
        elif name == "say" and not inside:
            role, inside = unescape(formatted[at : mark.start()]), True
        elif name == "/turn":
            text(mark.start())
            yield role, parts
        elif inside:
            text(mark.start())
            parts.append(tuple(name.split(":")))
        at = mark.end()


PIECES = (
    "piece long, formatted string, loss_spans array<struct<start:long,end:long>>, "
    "attachments array<struct<index:int,kind:string,ref:string,tokens:long>>"
)


def format_conversations(
    turns: DataFrame, parts: Column, expansion: Expansion = Expansion(), loss_roles: tuple[str, ...] = LOSS_ROLES, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """(conv_id, piece, formatted, loss_spans, attachments): conversations as text, in pieces of whole turns.

    ``turns`` has conv_id, turn and role, ``parts`` gives the content of a turn (array of ``PART``, null is empty). Turns
    stand by turn number, those of equal number by role and content; nulls come first, repeated rows stay. A null role is
    an empty one, rows without conv_id are one conversation. Other columns are not read.

    Spans count characters of their piece and cover the escaped text parts of ``loss_roles``. The k-th attachment of a
    piece stands in it as ``<kind:k>``; ``tokens`` is what it expands to.

    Rows are dealt by ranges of conversation and turn, so a conversation that holds a third of all rows is written by
    many tasks; a task holds one piece at a time. ``piece`` rises along a conversation. One piece is a conversation's
    whole text unless it is longer than ``piece_chars`` or lies across two ranges.
    """
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), parts.alias("parts"))
    keys = ["conv_id", "turn", "role", "content"]
    dealt = rows.withColumn("content", F.md5(F.to_json("parts"))).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        current, writer = None, None

        def piece() -> pa.RecordBatch:
            nonlocal number
            number += 1
            spans = [{"start": a, "end": b} for a, b in writer.spans]
            attached = [dict(zip(("index", "kind", "ref", "tokens"), a, strict=True)) for a in writer.attachments]
            row = [[current], [number], ["".join(writer.out)], [spans], [attached]]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(row, _PIECE_TYPES, strict=True)], _PIECE_NAMES)

        for batch in batches:
            ids, roles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for conv, role, content in zip(ids, roles, batch.column(2), strict=True):
                if writer is not None and (conv != current or writer.chars > piece_chars):
                    yield piece()
                    writer = None
                if writer is None:
                    current, writer = conv, Flattener(expansion, loss_roles)
                writer.turn(role, content.as_py() or [])
        if writer is not None:
            yield piece()

    return dealt.select("conv_id", "role", "parts").mapInArrow(run, f"conv_id long, {PIECES}")


_PIECE_NAMES = ["conv_id", "piece", "formatted", "loss_spans", "attachments"]
_PIECE_TYPES = [
    pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])),
]


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from formatted pieces.

    ``turns_sha256`` covers role, a line end, the texts and a line end of each turn, ``loss_sha256`` all text under the
    loss spans, unescaped. Pieces of a conversation come to one task in order, which hashes them as they stream by: a
    digest has to be taken in order, but neither turns nor texts of a conversation are gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        finish: Callable[[], tuple] = lambda: (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, conv in enumerate(ids):
                if state is None or conv != current:
                    if state is not None:
                        done.append(finish())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = batch.column(2)[i].as_py()
                for role, parts in read_back(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{''.join(v for kind, v in parts if kind == 'text')}\n".encode())
                for span in batch.column(3)[i].as_py():
                    learnt = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(formatted)
            if done:
                yield _digest_batch(done)
                done = []
        if state is not None:
            yield _digest_batch([finish()])

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
