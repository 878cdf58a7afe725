"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

A template gives each role the markers around its text and says whether the text counts for the loss, and which roles may
follow which. The machine walks a conversation's rows in order of turn and emits segments of text, each with its loss flag;
markers never count. Every turn carries whether the machine accepts it where it stands; turns it rejects are formatted too,
and the machine goes on from them as if they had been accepted. Control strings of the template inside texts are escaped,
and ``read_back`` recovers roles, texts and the text under the loss mask from the formatted text alone.

Rows of a conversation with equal turns follow in order of role and text; null turns come first. Null roles and texts are
empty. Roles that the template does not know get a marker that names them. Conversations are streamed: no more than one turn
is held at a time, however long a conversation is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded, n_parts

START = "start"


@dataclass(frozen=True)
class Part:
    """The markers around a role's text, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Part]
    #: Marker of roles that are not among ``roles``: before their name, between name and text, after the text.
    other: tuple[str, str, str]
    #: Role, or START -> roles that may come next.
    follows: dict[str, tuple[str, ...]]
    #: Roles a conversation may end with.
    ends: tuple[str, ...]
    begin: str = ""
    escape: str = "\\"
    controls: tuple[str, ...] = field(default=())

    def all_controls(self) -> list[str]:
        """Longest first: the template's markers without the white space around them, and further strings to escape."""
        marks = [m for p in self.roles.values() for m in (p.before, p.after)] + [*self.other, self.begin, *self.controls]
        return sorted({m.strip() for m in marks} - {""}, key=lambda m: (-len(m), m))


INSTRUCT = Template(
    roles={"system": Part("<<SYS>>\n", "\n<</SYS>>\n"), "user": Part("[INST] ", " [/INST]"),
           "assistant": Part("<reply> ", " </s>", loss=True)},
    other=("<role> ", " <text> ", " </role>"),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
    begin="<s>",
)


def escaper(template: Template):
    """Puts the escape character behind the first character of every control string and of every escape character."""
    e = template.escape
    inside = re.compile("(?=" + "|".join(re.escape(c) for c in [e, *template.all_controls()]) + ")(.)", re.S)
    return lambda text: inside.sub(lambda m: m[1] + e, text)


def unescaper(template: Template):
    e = re.escape(template.escape)
    pair = re.compile(f"({e}){e}|{e}")
    return lambda text: pair.sub(lambda m: m[1] or "", text)


class Machine:
    """Formats the turns of one conversation."""

    def __init__(self, template: Template):
        self.template, self.escape, self.state = template, escaper(template), START

    def turn(self, role: str, text: str) -> tuple[bool, list[tuple[str, bool]]]:
        """Whether the turn may stand here, and its segments."""
        t = self.template
        fits = role in t.follows.get(self.state, ())
        first = t.begin if self.state == START else ""
        self.state = role
        if (part := t.roles.get(role)) is not None:
            return fits, [(first + part.before, False), (self.escape(text), part.loss), (part.after, False)]
        name, between, after = t.other
        return fits, [(first + name + self.escape(role) + between, False), (self.escape(text), False), (after, False)]


def parser(template: Template):
    """Splits formatted text into turns: (role, text, whether it counts for the loss)."""
    unescape = unescaper(template)
    kinds = [(re.escape(p.before), r, p.after, p.loss) for r, p in template.roles.items()]
    name, between, after = map(re.escape, template.other)
    turn = re.compile("|".join(f"{b}(?P<t{i}>.*?){re.escape(a)}" for i, (b, _, a, _) in enumerate(kinds))
                      + f"|{name}(?P<role>.*?){between}(?P<text>.*?){after}", re.S)

    def parse(formatted: str) -> Iterator[tuple[str, str, bool]]:
        at = len(template.begin) if formatted.startswith(template.begin) else 0
        while at < len(formatted):
            m = turn.match(formatted, at)
            if m is None:
                raise ValueError(f"not a formatted turn: {formatted[at:at + 60]!r}")
            if m["text"] is not None:
                yield unescape(m["role"]), unescape(m["text"]), False
            else:
                i = next(i for i in range(len(kinds)) if m[f"t{i}"] is not None)
                yield kinds[i][1], unescape(m[f"t{i}"]), kinds[i][3]
            at = m.end()

    return parse


_SEGMENT = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int32()), ("text", pa.string()),
                      ("loss", pa.bool_()), ("accepted", pa.bool_())])
_SEGMENT_SQL = "conv_id bigint, turn_no bigint, segment int, text string, loss boolean, accepted boolean"


def format_conversations(conversations: DataFrame, template: Template = INSTRUCT, parts: int | None = None) -> DataFrame:
    """Segments of all conversations: conv_id, turn_no (from 0), segment (0 marker, 1 text, 2 marker), text, loss, accepted.

    The segments of a conversation stand one after another in one partition.
    """
    rows = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    dealt = rows.repartition(parts or n_parts(conversations), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, n = object(), None, 0
        for batch in batches:
            for small in bounded(batch, 4_000_000):
                out = []
                for conv_id, _, role, text in zip(*(c.to_pylist() for c in small.columns)):
                    if conv_id != current:
                        current, machine, n = conv_id, Machine(template), 0
                    fits, segments = machine.turn(role, text)
                    out += [(conv_id, n, i, s, loss, fits) for i, (s, loss) in enumerate(segments)]
                    n += 1
                yield batch_of(_SEGMENT, *zip(*out))

    return dealt.mapInArrow(run, _SEGMENT_SQL)


_SUMMARY = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """A row for each conversation, read from the formatted text and the loss mask of ``format_conversations``' output.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed of each turn), loss_chars and loss_sha256 (of the text
    under the mask, unescaped), formatted_chars, valid (the machine accepted every turn and the last one may end it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, unescape = parser(template), unescaper(template)
        current, open_, pending = object(), None, ""

        def close():
            conv_id, n, turns, loss_chars, loss, chars, valid, last = open_
            return conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid and last in template.ends

        for batch in batches:
            out = []
            for conv_id, _, segment, text, loss, accepted in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != current:
                    if open_ is not None:
                        out.append(close())
                    current, pending, open_ = conv_id, "", [conv_id, 0, sha256(), 0, sha256(), 0, True, None]
                open_[5] += len(text)
                open_[6] = open_[6] and accepted
                if loss:
                    plain = unescape(text)
                    open_[3] += len(plain)
                    open_[4].update(plain.encode())
                pending += text
                if segment == 2:  # a turn is complete
                    for role, said, _ in parse(pending):
                        open_[1] += 1
                        open_[2].update(f"{role}\n{said}\n".encode())
                        open_[7] = role
                    pending = ""
            if out:
                yield batch_of(_SUMMARY, *zip(*out))
        if open_ is not None:
            yield batch_of(_SUMMARY, *zip(close()))

    return segments.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                                    "formatted_chars bigint, valid boolean")


def joined(segments: Iterable[tuple[str, bool]]) -> str:
    return "".join(s for s, _ in segments)
