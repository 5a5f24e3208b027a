"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template gives, for each role, the control strings around a turn and whether the text counts for the loss, and the
machine's moves: (state, role) -> state. Control strings inside texts are escaped reversibly, so that no text can open or
close a turn. Turns come in the order (turn, role, text); repeated rows are turns too. Null roles are the role "" (empty),
null texts empty texts. A role the template doesn't know gets the generic markers and never the loss. A turn that the
machine has no move for is formatted all the same and marked `valid = false`, as are all later ones of its conversation.

Segments of one conversation come from one task, in order, in constant memory: a conversation streams through and is
never gathered. Their texts, one after the other, are the written conversation; `Parser` reads that text alone back into
turns, by the control strings and the machine, a turn at a time.

Empty tables give empty results; extra columns go. Ties of (turn, role, text) are equal turns, so their order is all one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, read, slices


@dataclass(frozen=True)
class Turn:
    """How a role's turn is written; `loss`: its text is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    #: Around the role's name, and after the text, of a role that isn't in `turns`.
    other: tuple[str, str, str]
    moves: dict[tuple[str, str], str]
    start: str = "start"
    escape: str = "\\"
    controls: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        """Every control string ends in a character that no control string begins with, so a text's end can't complete one."""
        marks = self.controls or tuple(dict.fromkeys([x for t in self.turns.values() for x in (t.before.strip(), t.after.strip())] + list(self.other)))
        object.__setattr__(self, "controls", marks)
        if {m[-1] for m in marks} & {m[0] for m in marks} or any(self.escape in m for m in marks):
            raise ValueError("control strings must not end as others begin, nor hold the escape sign")

    def step(self, state: str | None, role: str) -> str | None:
        """The state after a turn; None: there is no such move."""
        return None if state is None else self.moves.get((state, role))

    def hide(self, text: str) -> str:
        """Control strings become `\\k;`, the escape sign is doubled."""
        esc = self.escape
        text = text.replace(esc, esc + esc)
        for k, mark in enumerate(self.controls):
            text = text.replace(mark, f"{esc}{k};")
        return text

    def show(self, text: str) -> str:
        esc = re.escape(self.escape)
        return re.sub(rf"{esc}(?:({esc})|(\d+);)", lambda m: self.escape if m[1] else self.controls[int(m[2])], text)

    def parts(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """(kind, text, loss): the marker before, the text, the marker after; loss holds for learned texts only."""
        turn = self.turns.get(role)
        if turn is None:
            return [("mark", self.other[0] + self.hide(role) + self.other[1], False), ("text", self.hide(text), False), ("mark", self.other[2], False)]
        return [("mark", turn.before, False), ("text", self.hide(text), turn.loss), ("mark", turn.after, False)]


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", " </s>\n", loss=True),
    },
    other=("<<ROLE>>", "<</ROLE>>", "<</TURN>>"),
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
)

SEGMENTS = "conv_id long, turn long, segment long, kind string, text string, loss boolean, valid boolean"


def format_chats(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments of all turns, by conversation in order within a partition: (conv_id, turn, segment, kind, text, loss, valid).

    `segment` counts from 0 within a conversation; the concatenated texts are the formatted conversation.
    """
    bound_batches(chats.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n = object(), template.start, 0
        for batch in slices(batches, 2048):
            out: list[list] = [[] for _ in range(7)]
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last:
                    last, state, n = conv, template.start, 0
                state = template.step(state, role)
                for kind, piece, loss in template.parts(role, text):
                    for column, value in zip(out, (conv, turn, n, kind, piece, loss, state is not None), strict=True):
                        column.append(value)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    turns = chats.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


class Parser:
    """Turns of a written conversation that comes in pieces, wherever it is cut: what isn't a whole turn yet waits."""

    def __init__(self, template: Template):
        self.template, self.left, self.role, self.after, self.seen = template, "", None, "", 0

    def opening(self) -> bool:
        """Takes an opening marker off the text; False if more text is needed."""
        t, text = self.template, self.left
        known = [r for r, turn in t.turns.items() if text.startswith(turn.before)]
        if known:
            self.role = max(known, key=lambda r: len(t.turns[r].before))
            self.left, self.after = text[len(t.turns[self.role].before) :], t.turns[self.role].after
        elif text.startswith(t.other[0]) and t.other[1] in text:
            name, _, self.left = text[len(t.other[0]) :].partition(t.other[1])
            self.role, self.after = t.show(name), t.other[2]
        elif text.startswith(t.other[0]) or any(m.startswith(text) for m in (t.other[0], *[x.before for x in t.turns.values()])):
            return False
        else:
            raise ValueError(f"no turn begins with {text[:40]!r}")
        self.seen = 0
        return True

    def closing(self) -> str | None:
        """A turn's text, once its closing marker is there. The marker's own white space isn't the text's."""
        mark = self.after.strip()
        at = self.left.find(mark, max(0, self.seen - len(mark)))
        begin = at - self.after.index(mark)
        if at < 0 or len(self.left) < begin + len(self.after):
            self.seen = len(self.left) if at < 0 else at
            return None
        if not self.left.startswith(self.after, begin):
            raise ValueError(f"{mark!r} is no closing marker in {self.left[begin : begin + 40]!r}")
        text, self.left = self.left[:begin], self.left[begin + len(self.after) :]
        return self.template.show(text)

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that end in the text so far."""
        self.left += piece
        while self.left:
            if self.role is None and not self.opening():
                return
            if (text := self.closing()) is None:
                return
            role, self.role = self.role, None
            yield role, text

    def end(self) -> None:
        if self.left or self.role is not None:
            raise ValueError(f"a conversation ends within a turn, at {self.left[:40]!r}")


def digests(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What is read back from the written conversations, one row for each; of `segments`, as `format_chats` gives them, only ids and texts are read."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        parser, last, state, n, chars, learned = None, None, None, 0, 0, 0
        all_, loss_ = hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            if parser:
                parser.end()
                rows.append((last, n, all_.hexdigest(), learned, loss_.hexdigest(), chars, state is not None))

        def batch_of() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for conv, number, piece in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "text")), strict=True):
                if number == 0:
                    close()
                    parser, last, state, n, chars, learned = Parser(template), conv, template.start, 0, 0, 0
                    all_, loss_ = hashlib.sha256(), hashlib.sha256()
                chars += len(piece)
                for role, text in parser.feed(piece):
                    n, state = n + 1, template.step(state, role)
                    all_.update(f"{role}\n{text}\n".encode())
                    if role in template.turns and template.turns[role].loss:
                        learned += len(text)
                        loss_.update(text.encode())
            if len(rows) >= 4096:
                yield batch_of()
                rows.clear()
        close()
        yield batch_of()

    return segments.select("conv_id", "segment", "text").mapInArrow(run, schema)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    return digests(format_chats(chats.unionByName(more)))
