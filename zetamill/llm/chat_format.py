"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  Successive prefixes of a conversation are
rendered and consecutive outputs compared: what a turn adds is its span, and an output that doesn't begin with the one
before it shows a template that rewrites history.  Where a turn's text stands inside its span is found by rendering
the turn with two different one-letter texts: what these outputs share before and after is the turn's frame.

Conversations are streamed: rows are dealt by conversation and sorted by turn.  Prefixes are those of the whole
conversation: each turn costs three renderings of all turns up to it, so the time grows with the square of a conversation's
turns, which a black box doesn't allow to avoid; a task holds one conversation and two outputs.  For a template that renders
turns independently of the turns before them a number of turns for a segment can be given: the memory and the number of
renderings of a very long conversation are then bounded by the segment, and at each boundary both sides are also
rendered together; where that isn't their outputs one after the other, the operator fails.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)
SCHEMA = "conv_id long, segment long, n_turns int, formatted string, rewrites boolean, starts array<long>, ends array<long>, text_starts array<long>, text_ends array<long>, loss array<boolean>"


def escape(text: str) -> str:
    """text without control strings; unescape() undoes it."""
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The template in use: <s>role[INST]text[/INST]</s> for each turn, roles and texts escaped."""
    return "".join(f"<s>{escape(role)}[INST]{escape(text)}[/INST]</s>" for role, text in turns)


def parse_turns(formatted: str) -> list[Turn]:
    """The turns that marked_turns() was given."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def locate(template: Template, turns: list[Turn]) -> tuple[str, bool, list[tuple[int, int, int, int]]]:
    """(output, rewrites, spans): for each turn where its span and its text begin and end in the output.

    Where the template rewrites history (an output doesn't begin with the one before it) spans are empty.
    """
    out, spans = template([]), []
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        if not now.startswith(out):
            return template(turns), True, []
        a, b = (template([*turns[:i], (role, letter)]) for letter in "ab")
        head = len(os.path.commonprefix([a, b]))
        tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
        spans.append((len(out), len(now), head, len(now) - tail))
        out = now
    return out, False, spans


def _render(template: Template, loss_role: str, segment: int | None):
    before: list = [[], ""]

    def flush(conv_id, number: int, turns: list[Turn], rows: list) -> None:
        formatted, rewrites, spans = locate(template, turns)
        if number and template(before[0] + turns) != before[1] + formatted:
            raise ValueError(f"the template renders segment {number} of conversation {conv_id} otherwise after the one before it; give no segment")
        before[:] = turns, formatted
        columns = [list(x) for x in zip(*spans, strict=True)] or [[], [], [], []]
        rows.append((conv_id, number, len(turns), formatted, rewrites, *columns, [role == loss_role for role, _ in turns]))

    def batch_of(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.bool_())]
        names = ["conv_id", "segment", "n_turns", "formatted", "rewrites", "starts", "ends", "text_starts", "text_ends", "loss"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        now, number, turns, rows = nothing, 0, [], []
        for batch in batches:
            for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv_id != now or len(turns) == segment:
                    if turns:
                        flush(now, number, turns, rows)
                    number = number + 1 if conv_id == now else 0
                    now, turns = conv_id, []
                    if len(rows) >= 1000:
                        yield batch_of(rows)
                        rows = []
                turns.append((role, text))
        if turns:
            flush(now, number, turns, rows)
        if rows:
            yield batch_of(rows)

    return run


def format_conversations(rows: DataFrame, template: Template = marked_turns, loss_role: str = "assistant", segment: int | None = None) -> DataFrame:
    """One row for each conversation of rows(conv_id, turn, role, text, ...), or for each of its segments of so many turns where
    segment is given, in order within a partition.

    formatted is the template's output, starts and ends are the turns' spans in it, text_starts and text_ends those of
    their texts, loss says which turns' texts are under the loss mask (those of loss_role).  rewrites marks rows for
    which the template rewrites history; these have no spans.  Turns are ordered by turn, nulls first, ties by role and
    text; repeated rows are turns of their own.  A null role or text is empty.  Rows with a null conv_id make one
    conversation.  Other columns are ignored; an empty table gives an empty table.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(_render(template, loss_role, segment), SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, read back from its formatted segments, which come in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list = []
    state = None

    def row() -> tuple:
        conv_id, n, turns, chars, loss, size = state
        return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        data = batch.to_pydict()
        for i in range(batch.num_rows):
            if data["segment"][i] == 0:
                if state is not None:
                    done.append(row())
                state = [data["conv_id"][i], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            formatted = data["formatted"][i]
            for role, text in parse_turns(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for start, end, loss in zip(data["text_starts"][i], data["text_ends"][i], data["loss"][i], strict=True):
                if loss:
                    text = unescape(formatted[start:end])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
            state[5] += len(formatted)
        if len(done) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done = []
    if state is not None:
        done.append(row())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of format_conversations()'s rows.

    It must be given those rows in their order (no shuffle in between), and the template marked_turns.
    """
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
