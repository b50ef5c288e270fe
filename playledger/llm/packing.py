"""Packing token sequences into fixed windows: bounded-space best fit.

Each task keeps `OPEN` open windows. A document's tokens are cut into full windows and a rest.
The rest goes into the open window that it fills best. If it fits in none, the fullest window
is closed: nearly full ones are padded, others are filled with the head of the rest, which is
then placed again. The windows left open in all tasks are packed once more, many tasks' at a
time, and the last ones of all are cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .merging import PairTable, merge_words

WINDOW, OPEN, END = 2048, 32, 1
#: A window that lacks no more than this is closed as it is.
SLACK = 6
#: Tasks of the first round whose rests meet in one task of the second.
GATHERED = 16
#: Distinct words and their ids that one Python worker remembers; texts that learn together.
REMEMBERED, TOGETHER = 500_000, 256

#: Texts with other characters are left to the library: their lower case, normal form, class or
#: kind of white space may differ between libraries. So are texts that may hold special tokens.
_OTHER = re.compile(
    "[^\t\n\v\f\r -~\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u012f\u0131-\u01ba"
    "\u01bc-\u01bf\u01c4-\u024f\u2010-\u2015\u2018-\u201e\u2026]|<\\|")


def _parts_pattern() -> re.Pattern:
    """Runs of letters, single digits, contractions and runs of other signs, of lower-case text."""
    usual = [c for c in map(chr, range(0x2030)) if not _OTHER.search(c)]
    lower = {x for c in usual for x in c.lower() if not x.isspace()}
    letters = re.escape("".join(sorted(c for c in lower if c.isalpha())))
    signs = re.escape("".join(sorted(c for c in lower if not c.isalnum())))
    return re.compile(f"[{letters}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[{signs}]+")


_PARTS = _parts_pattern()
#: Longer words are encoded one by one.
LONG = 64


class WordTokens:
    """Ids of whole texts by a tokenizer (words by merges) that never reach over white space.

    Texts of Latin characters are cut into words by the tokenizer's pattern; every distinct word
    is encoded once and remembered, many at a time. The library encodes all other texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(
            np.array([ids[a] for a, _ in merges]), np.array([ids[b] for _, b in merges]),
            np.arange(len(merges)), np.array([ids[a + b] for a, b in merges]), max(ids.values()) + 1)
        names = _byte_names()
        self.inner = np.array([ids.get(c, -1) for c in names])
        self.final = np.array([ids.get(c + suffix, -1) for c in names])
        self.parts: dict[str, bytes] = {}

    def _learn_parts(self, found: set[str]) -> None:
        parts = self.parts
        new = [p for p in found if p not in parts and len(p) <= LONG]
        if new:
            data = [p.encode() for p in new]
            lengths = np.array([len(x) for x in data])
            codes = np.frombuffer(b"".join(data), dtype=np.uint8)
            symbols = self.inner[codes]
            last = np.cumsum(lengths) - 1
            symbols[last] = self.final[codes[last]]
            flat, counts = merge_words(symbols, lengths, self.pairs)
            raw, at = flat.astype("<u4").tobytes(), 0
            for part, end in zip(new, (4 * np.cumsum(counts)).tolist()):
                parts[part] = raw[at:end]
                at = end
        for part in found:
            if len(part) > LONG and part not in parts:
                parts[part] = self._by_library(part)

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = self.parts
        for at in range(0, len(texts), TOGETHER):
            some = texts[at:at + TOGETHER]
            split = [None if _OTHER.search(t) else _PARTS.findall(t.lower()) for t in some]
            if len(parts) > REMEMBERED:
                parts.clear()
            self._learn_parts(set().union(*filter(None, split)))
            for text, own in zip(some, split):
                yield self._by_library(text) if own is None else b"".join([parts[p] for p in own])


def _byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: visible Latin-1
    characters for themselves, the others in order from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_OPENED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One encoder for each worker process, so that what it remembers serves all its tasks."""
    if path not in _OPENED:
        _OPENED[path] = WordTokens(path)
    return _OPENED[path]


@dataclass
class Piece:
    doc: tuple
    start: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:4 * n]), Piece(self.doc, self.start + n, self.ids[4 * n:])


@dataclass
class Packer:
    """Open windows of one task; closed ones are handed out by `put` and `rest`."""

    window: int = WINDOW
    limit: int = OPEN
    slack: int = SLACK
    open: list[list[Piece]] = field(default_factory=list)
    filled: list[int] = field(default_factory=list)

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece) >= self.window:
            head, piece = piece.cut(self.window)
            yield [head]
        while len(piece):
            room = [self.window - n for n in self.filled]
            fits = [i for i, r in enumerate(room) if r >= len(piece)]
            if fits:
                i = min(fits, key=lambda i: room[i])
                self.open[i].append(piece)
                self.filled[i] += len(piece)
                if self.filled[i] == self.window:
                    yield self._close(i)
                return
            if len(self.open) < self.limit:
                self.open.append([piece])
                self.filled.append(len(piece))
                return
            i = min(range(len(room)), key=lambda i: room[i])
            if room[i] > self.slack:
                head, piece = piece.cut(room[i])
                self.open[i].append(head)
            yield self._close(i)

    def _close(self, i: int) -> list[Piece]:
        self.filled.pop(i)
        return self.open.pop(i)

    def rest(self) -> Iterator[list[Piece]]:
        while self.open:
            yield self._close(len(self.open) - 1)


def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """One window's pieces as windows whose lengths are powers of two, the largest first."""
    left = sum(map(len, pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        own = []
        while size:
            piece = pieces.pop(0)
            if len(piece) > size:
                piece, tail = piece.cut(size)
                pieces.insert(0, tail)
            own.append(piece)
            size -= len(piece)
        yield own


_COLUMNS = ["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "ids", "task"]
_FORM = ("doc_id BIGINT, row_key BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, "
         "sequence BIGINT, offset BIGINT, ids BINARY, task INT")


class _Rows:
    """Collects output rows and hands them out in frames of bounded size."""

    def __init__(self, task: int):
        self.task, self.rows, self.sequence, self.size = task, [], 0, 0

    def closed(self, pieces: list[Piece], keep_ids: bool = False) -> None:
        at = 0
        for p in pieces:
            doc_id, key, total = p.doc
            self.rows.append((doc_id, key, p.start, len(p), zlib.crc32(p.ids), total, self.sequence, at,
                              p.ids if keep_ids else None, self.task))
            at += len(p)
            self.size += len(p.ids) if keep_ids else 64
        self.sequence += 1

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=_COLUMNS).astype({"doc_id": "Int64"})
        self.rows, self.size = [], 0
        return out


def _first_round(path: str, window: int, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, packer = word_tokens(path), Packer(window, limit)
        rows = _Rows(TaskContext.get().partitionId())
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            found = encoder.encode(batch["text"].tolist())
            for doc_id, key, ids in zip(batch["doc_id"], batch["row_key"], found):
                ids += end
                doc = (None if pd.isna(doc_id) else int(doc_id), int(key), len(ids) // 4)
                for pieces in packer.put(Piece(doc, 0, ids)):
                    rows.closed(pieces)
                if len(rows.rows) >= 4096:
                    yield rows.frame()
            if rows.rows:
                yield rows.frame()
        for pieces in packer.rest():
            rows.closed(pieces, keep_ids=True)
        if rows.rows:
            yield rows.frame()

    return run


def _last_round(window: int, limit: int):
    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        packer, rows = Packer(window, limit), _Rows(int(key[0]))
        found = found.sort_values(["task", "sequence", "offset"])
        left: list[list[Piece]] = []
        for r in found.itertuples():
            doc = (None if pd.isna(r.doc_id) else int(r.doc_id), int(r.row_key), int(r.doc_tokens))
            left.extend(packer.put(Piece(doc, int(r.start), bytes(r.ids))))
        for pieces in left:
            rows.closed(pieces)
        # What is still open is joined end to end.
        last = Packer(window, 1, 0)
        for pieces in list(packer.rest()):
            for piece in pieces:
                for full in last.put(piece):
                    rows.closed(full)
        for pieces in last.rest():
            for own in _powers(pieces):
                rows.closed(own)
        return rows.frame()

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, limit: int = OPEN) -> DataFrame:
    """One row for each piece of a document in a window.

    Returns doc_id, start (the document's tokens before the piece), length, ids_crc32 (of its
    ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id and offset (in the
    window). A document's tokens are those of its whole text and one end token, so null and
    empty texts have one token. Rows with a null doc_id are packed too; rows that repeat a
    doc_id are documents of their own. An empty table gives no rows. Every token is in exactly
    one piece. `window` must be a power of two.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("row_key"))
    # Written once: both what is closed and what is left open come from one run of the tokenizer.
    first = stored(rows.mapInPandas(_first_round(path, window, limit), _FORM))
    closed = first.where(F.col("ids").isNull())
    left = first.where(F.col("ids").isNotNull()).withColumn("_group", F.floor(F.col("task") / GATHERED).cast("int"))
    merged = left.groupBy("_group").applyInPandas(_last_round(window, limit), _FORM)
    # Even numbers for the first round, odd ones for the second.
    number = (F.col("task").cast("bigint") * (1 << 36) + F.col("sequence")) * 2
    return closed.withColumn("sequence_id", number).unionByName(
        merged.withColumn("sequence_id", number + 1)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
