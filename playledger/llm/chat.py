"""Chat formatting by columnar byte assembly.

Turns are dealt by ranges of (conversation, block of turn numbers) and sorted; a task formats
a few megabytes of turns at a time. For each turn the lengths of five segments (mark, role,
mark, text, mark) are known; their cumulative sum gives every segment's offset, scatter indices
say where each byte goes, and marks and contents are copied into one preallocated Arrow buffer.
No turn is joined as a Python string.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings inside roles and
texts get a backslash after their first character, and those that have backslashes there one
more, so no text can end a turn and `unescape` restores every text.

The loss mask are spans of code points of the formatted text: the texts of assistant turns.
`read_back` takes everything from the formatted text and the mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks of the template, and control strings of this and other chat templates.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (
    START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)

#: Turn numbers of one block: all turns of a block are formatted by one task.
BLOCK = 256
#: Bytes of turns that are assembled at a time.
AT_ONCE = 8 << 20
#: Longer segments are copied as slices.
LONG = 1 << 16

#: First character of control strings -> the alternatives of what follows it.
_RESTS = {
    first: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first)
    for first in sorted({c[0] for c in CONTROL})
}
ESCAPE = {first: f"({re.escape(first)})(\\\\*)({rest})" for first, rest in _RESTS.items()}
_UNESCAPE = [re.compile(f"({re.escape(first)})\\\\(\\\\*)({rest})") for first, rest in _RESTS.items()]

FORMATTED = ("conv_id BIGINT, part BIGINT, complete BOOLEAN, n_turns BIGINT, formatted STRING, "
             "loss_starts ARRAY<BIGINT>, loss_ends ARRAY<BIGINT>")
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("complete", pa.bool_()), ("n_turns", pa.int64()),
    ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())),
])


def escape(texts: pa.Array) -> pa.Array:
    """Texts in which no control string is left."""
    for pattern in ESCAPE.values():
        texts = pc.replace_substring_regex(texts, pattern=pattern, replacement=r"\1\\\2\3")
    return texts


def unescape(text: str) -> str:
    if "\\" in text:
        for pattern in _UNESCAPE:
            text = pattern.sub(r"\1\2\3", text)
    return text


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of an array without nulls, and each value's start and length in them."""
    texts = texts.cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copy the i-th segment of `data` to place `to[i]`, all short ones by one index."""
    for i in np.flatnonzero(lengths > LONG):
        out[to[i]:to[i] + lengths[i]] = data[starts[i]:starts[i] + lengths[i]]
    short = lengths <= LONG
    to, starts, lengths = to[short], starts[short], lengths[short]
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(to, lengths) + inside] = data[np.repeat(starts, lengths) + inside]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> pa.RecordBatch:
    """Formatted texts and loss masks of blocks; `first` has the places of the blocks' first turns.

    Roles and texts have no nulls."""
    n = len(roles)
    marks = [np.frombuffer(m.encode(), dtype=np.uint8) for m in (START, SEP, END)]
    own = [_parts(escape(roles)), _parts(escape(texts))]
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:, 0::2] = [len(m) for m in marks]
    lengths[:, 1], lengths[:, 3] = own[0][2], own[1][2]
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    places = ends - lengths
    total = int(ends[-1, -1])
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, dtype=np.uint8)
    for column, mark in zip((0, 2, 4), marks):
        out[places[:, column, None] + np.arange(len(mark))] = mark
    for column, (data, starts, sizes) in zip((1, 3), own):
        _scatter(out, places[:, column], data, starts, sizes)
    begins = places[first, 0]
    offsets = np.append(begins, total).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer)

    # The mask in code points: bytes that go on a character do not count.
    taught = np.flatnonzero(pc.equal(roles, "assistant").to_numpy(zero_copy_only=False))
    block = np.searchsorted(first, taught, side="right") - 1
    spans = []
    at = np.append(0, np.cumsum((out & 0xC0) != 0x80)) if total and out.max() > 127 else np.arange(total + 1)
    for edge in (places[taught, 3], ends[taught, 3]):
        values = at[edge] - at[begins[block]]
        counts = np.searchsorted(block, np.arange(len(first) + 1))
        spans.append(pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(values, pa.int64())))
    turns = np.diff(np.append(first, n))
    return pa.record_batch([pa.array(turns, pa.int64()), formatted, *spans],
                           names=["n_turns", "formatted", "loss_starts", "loss_ends"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as blocks. A block that may have others of its conversation elsewhere (the
    first and last one of the task, and any beside one of the same conversation) is not complete."""
    part = TaskContext.get().partitionId() << 40
    held: pa.RecordBatch | None = None  # the last block so far
    before: list | None = None  # the conversation before it; none yet at the task's start

    def finished(rows: pa.Table) -> pa.RecordBatch:
        nonlocal part
        rows = rows.combine_chunks()
        first = _starts(rows)
        made = assemble(rows["role"].chunk(0), rows["text"].chunk(0), first)
        parts = pa.array(np.arange(part, part + len(first)), pa.int64())
        part += len(first)
        conv = rows["conv_id"].chunk(0).take(pa.array(first))
        return pa.record_batch(
            [conv, parts, pa.nulls(len(first), pa.bool_()), *made.columns], schema=_ARROW)

    def flagged(rows: pa.RecordBatch, following: list | None) -> pa.RecordBatch:
        """`following`: the conversation after these blocks, in a list; None at the task's end."""
        nonlocal before
        names = rows["conv_id"].to_pylist()
        around = [before, *([x] for x in names), following]
        whole = [around[i] is not None and around[i + 2] is not None and around[i] != around[i + 1] != around[i + 2]
                 for i in range(len(names))]
        before = [names[-1]]
        return rows.set_column(2, "complete", pa.array(whole, pa.bool_()))

    for rows in _pieces(batches):
        found = finished(rows)
        if held is not None:
            found = pa.Table.from_batches([held, found]).combine_chunks().to_batches()[0]
        if len(found) > 1:
            yield flagged(found.slice(0, len(found) - 1), [found["conv_id"][len(found) - 1].as_py()])
        held = found.slice(len(found) - 1)
    if held is not None:
        yield flagged(held, None)


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a new (conversation, block) begins."""
    changed = np.ones(len(rows), dtype=bool)
    for name in ("conv_id", "block"):
        column = rows[name].combine_chunks()
        values = column.fill_null(0).to_numpy(zero_copy_only=False)
        null = column.is_null().to_numpy(zero_copy_only=False)
        differs = (values[1:] != values[:-1]) | (null[1:] != null[:-1])
        changed[1:] = differs if name == "conv_id" else changed[1:] | differs
    return np.flatnonzero(changed)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Turns in pieces of whole blocks; a block above `AT_ONCE` comes in several pieces."""
    waiting: pa.Table | None = None
    for batch in batches:
        for at in range(0, len(batch), 512):
            some = pa.Table.from_batches([batch.slice(at, 512)])
            waiting = some if waiting is None else pa.concat_tables([waiting, some])
            if waiting.nbytes < AT_ONCE:
                continue
            last = _starts(waiting)[-1]
            if last:
                yield waiting.slice(0, last)
                waiting = waiting.slice(last)
            if waiting.nbytes >= AT_ONCE:
                yield waiting
                waiting = None
    if waiting is not None and len(waiting):
        yield waiting


def format_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of formatted turns: conv_id, part, complete, n_turns, formatted, loss_starts, loss_ends.

    Turns of a conversation are ordered by turn, then role, then text, a null turn first. A
    conversation is one row (`complete`, or alone with its id) unless it has turns of several
    blocks or of more than `AT_ONCE` bytes: then its rows follow each other by `part`. Null
    texts and roles count as empty, repeated rows as further turns, rows without conv_id as one
    conversation; an empty table gives no rows; further columns are ignored. A very long text is
    copied as a slice; one turn must stay below 2 GB with its marks. Turns that share
    conversation and block are one task's work, in bounded memory.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / block))
    dealt = rows.repartitionByRange("conv_id", "block").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "block", "role", "text").mapInArrow(_blocks, FORMATTED)


# -- reading back ------------------------------------------------------------------------

def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    found = []
    for turn in formatted.split(END)[:-1]:
        if not turn.startswith(START):
            raise ValueError(f"no turn begins here: {turn[:40]!r}")
        role, mark, text = turn[len(START):].partition(SEP)
        if not mark:
            raise ValueError(f"a turn without its text: {turn[:40]!r}")
        found.append((unescape(role), unescape(text)))
    return found


class _Digest:
    """What `read_back` returns of one conversation, from its parts in order."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text in turns_of(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for start, end in zip(starts, ends):
            text = unescape(formatted[start:end])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def values(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_READ = "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, formatted_chars BIGINT"
_READ_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
_HALF_ARROW = pa.schema([*_READ_ARROW, *(_ARROW.field(n) for n in ("part", "formatted", "loss_starts", "loss_ends"))])
_HALF = f"{_READ}, part BIGINT, formatted STRING, loss_starts ARRAY<BIGINT>, loss_ends ARRAY<BIGINT>"


def _digest_complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete rows as digests, others as they are."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["complete"]:
                digest = _Digest()
                digest.add(row["formatted"], row["loss_starts"], row["loss_ends"])
                row |= dict(zip(_DIGEST, digest.values())) | dict.fromkeys(
                    ("formatted", "loss_starts", "loss_ends"))
            else:
                row["n_turns"] = None
            row.pop("complete")
            yield pa.RecordBatch.from_pylist([row], schema=_HALF_ARROW) if row["formatted"] else row


def _in_batches(rows: Iterator) -> Iterator[pa.RecordBatch]:
    """Small rows together, batches as they come."""
    small = []
    for row in rows:
        if isinstance(row, dict):
            small.append(row)
            if len(small) < 4096:
                continue
        if small:
            yield pa.RecordBatch.from_pylist(small, schema=_HALF_ARROW)
            small = []
        if not isinstance(row, dict):
            yield row
    if small:
        yield pa.RecordBatch.from_pylist(small, schema=_HALF_ARROW)


def _digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by conversation and place as digests; one part is held at a time."""
    now, digest, out = None, None, []

    def closed() -> None:
        if digest is not None:
            out.append(dict(zip(_DIGEST, digest.values())) | {"conv_id": now[0]})

    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["turns_sha256"] is not None:
                out.append(row)
                continue
            if digest is None or now != [row["conv_id"]]:
                closed()
                now, digest = [row["conv_id"]], _Digest()
            digest.add(row["formatted"], row["loss_starts"], row["loss_ends"])
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist(out, schema=_READ_ARROW)
            out = []
    closed()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_READ_ARROW)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, from the formatted texts and masks alone.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and
    loss_sha256 (the text under the mask, unescaped), formatted_chars (code points). Complete
    rows are digested where they are; only parts of conversations that lie in several rows meet
    in one task, which takes them one after the other (a digest depends on their order).
    """
    halves = formatted.mapInArrow(lambda batches: _in_batches(_digest_complete(batches)), _HALF)
    return halves.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digest_parts, _READ)
