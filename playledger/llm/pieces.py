"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, then by place. The best
pair is joined and its new neighbours enter the agenda, until no pair is in the vocabulary.
Symbols that are no piece become byte pieces. A blank becomes the mark U+2581, and one mark
stands before the text. No piece has a mark after another character (checked when the model
is opened), so runs of marks with what follows them are encoded one by one and remembered.

Ids and decoding of every whole text are compared with the sentencepiece library, batch by batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merging import PairTable, merge_words

MARK = "▁"
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct runs that one Python worker remembers, and as many older ones.
REMEMBERED = 250_000
#: Longer runs are encoded one by one.
LONG = 40
#: Texts, and their characters, whose new runs are encoded together.
TOGETHER, CHARACTERS = 512, 1 << 20


class Pieces:
    """A merge-type vocabulary with its own encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.bytes = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif lib.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.ids[piece] = i
                self.scores[piece] = lib.get_score(i)
        if n > 0x110000:
            raise ValueError("vocabularies whose ids are no code points are not supported")
        if len(self.bytes) != 256:
            raise ValueError("a vocabulary with all byte pieces is needed")
        if MARK not in self.ids:
            raise ValueError("a vocabulary with a piece for the mark is needed")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece may hold marks at its start only")
        # id -> UTF-8 text of a piece
        self.texts = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {
            i: bytes([b]) for b, i in self.bytes.items()}
        self.plain = {i: p.replace(MARK, " ") for p, i in self.ids.items()}
        # Symbols: the pieces, and characters that only occur inside pieces.
        names = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - set(names)):
            names[c] = n + len(names)
        self.symbols = -2 - np.arange(0x110000)  # characters in no piece keep numbers below 0
        for c, i in names.items():
            if len(c) == 1:
                self.symbols[ord(c)] = i
        self.unlisted = {i: c for c, i in names.items() if i >= n}
        found = [(names[p[:i]], names[p[i:]], self.scores[p], k) for p, k in self.ids.items()
                 for i in range(1, len(p)) if p[:i] in names and p[i:] in names]
        left, right, score, joined = (np.array(x) for x in zip(*found))
        priority = np.unique(-score, return_inverse=True)[1]
        self.pairs = PairTable(left, right, priority, joined, max(names.values()) + 1)
        self.decimal = np.array([str(i) for i in range(n)], dtype=object)
        #: run without its first mark -> ids as code points; the older ones move back when they are met again
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: The decoded texts, without the first blank, of those runs of either that may have bytes.
        #: All others decode to themselves.
        self.foreign: dict[str, str] = {}
        self.foreign_older: dict[str, str] = {}
        #: Whether one of those decoded to something else than itself.
        self.altered = False

    def _long(self, run: str) -> list[int]:
        """Ids of one long run, by an agenda that is a heap."""
        scores = self.scores
        n = len(run)
        symbols: list[str | None] = list(run)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, str]] = []

        def enter(i: int, pair: str) -> None:
            if pair in scores:
                heapq.heappush(agenda, (-scores[pair], i, pair))

        for i in range(n - 1):
            enter(i, run[i:i + 2])
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or left + symbols[j] != pair:
                continue  # one of the two has changed since
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                enter(i, pair + symbols[k])
            if before[i] >= 0:
                enter(before[i], symbols[before[i]] + pair)
        return [x for s in symbols if s is not None for x in self._fallback(s)]

    def _spelled(self, flat: np.ndarray, lengths: np.ndarray, strange: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has: the strange symbols, which are no ids, are spelled."""
        symbols, which = np.unique(flat[strange], return_inverse=True)
        ids = [self._fallback(chr(-2 - x) if x < 0 else self.unlisted[x]) for x in symbols.tolist()]
        size = np.array([len(x) for x in ids])
        table = np.zeros((len(ids), size.max()), dtype=flat.dtype)
        used = np.arange(size.max()) < size[:, None]
        table[used] = np.concatenate(ids)
        count = np.ones(len(flat), dtype=np.int64)
        count[strange] = size[which]
        out = np.repeat(flat, count)
        out[np.repeat(strange, count)] = table[which][used[which]]
        return out, np.add.reduceat(count, np.cumsum(lengths) - lengths)

    def _fallback(self, symbol: str) -> list[int]:
        own = self.ids.get(symbol)
        return [own] if own is not None else [self.bytes[b] for b in symbol.encode()]

    def merge(self, runs: list[str]) -> list[list[int]]:
        """Ids of each run."""
        return [list(map(ord, ids)) for ids in self._merged(runs)[0]]

    def _merged(self, runs: list[str]) -> tuple[list[str], dict[int, str]]:
        """Ids of each run as code points, and the decoded texts of runs that may hold bytes, by place.
        Short runs share one agenda in arrays, long ones have heaps."""
        out, foreign = [""] * len(runs), {}
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        for i in np.flatnonzero(sizes > LONG).tolist():
            ids = self._long(runs[i])
            out[i], foreign[i] = _points(ids), self._text(ids)
        short = np.flatnonzero(sizes <= LONG).tolist()
        if not short:
            return out, foreign
        some = runs if len(short) == len(runs) else [runs[i] for i in short]
        codes = self.symbols[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        flat, lengths = merge_words(codes, sizes[short], self.pairs)
        strange = (flat < 0) | (flat >= len(self.decimal))
        spelled = np.flatnonzero(np.logical_or.reduceat(strange, np.cumsum(lengths) - lengths))
        if len(spelled):
            flat, lengths = self._spelled(flat, lengths, strange)
        ends = np.cumsum(lengths)
        points, starts = _points(flat), (ends - lengths).tolist()
        ends = ends.tolist()
        for i in spelled.tolist():
            foreign[short[i]] = self._text(flat[starts[i]:ends[i]].tolist())
        joined = [points[a:b] for a, b in zip(starts, ends)]
        if len(short) == len(runs):
            return joined, foreign
        for i, ids in zip(short, joined):
            out[i] = ids
        return out, foreign

    def _known(self, texts: list[str]) -> Iterator[tuple[list[str], str]]:
        """Ids of the runs of each text, all remembered, and the runs as one text again; the older half
        of what is known goes first. Runs are looked up while they are new, and only unknown ones kept."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
            self.foreign, self.foreign_older = {}, self.foreign
        get = self.known.get
        found, lacking, plain = [], [], []
        for text in texts:
            runs = self.runs(text)
            own = list(map(get, runs))
            found.append(own)
            lacking.append([run for run, ids in zip(runs, own) if ids is None] if None in own else [])
            plain.append(" ".join(runs))
        learnt = self._learn(set().union(*lacking))
        for text, own, new, same in zip(texts, found, lacking, plain):
            if new:
                ids = map(learnt.__getitem__, new)
                own = [next(ids) if x is None else x for x in own]
            if self.altered:
                runs = self.runs(text)
                same = " ".join(map(self.foreign.get, runs, runs))
            yield own, same

    def _learn(self, new: set[str]) -> dict[str, str]:
        """Ids of these runs, which are not among the younger ones yet."""
        older, lost = self.older, self.foreign_older
        learnt = {run: older[run] for run in new if run in older}
        self.foreign.update([(run, lost[run]) for run in learnt if run in lost])
        unknown = [run for run in new if run not in learnt]
        ids, spelled = self._merged([MARK + run for run in unknown])
        learnt.update(zip(unknown, ids))
        self.known.update(learnt)
        for i, text in spelled.items():
            # A run starts with a mark, which is never spelled in bytes.
            self.foreign[unknown[i]] = back = text.removeprefix(" ")
            self.altered = self.altered or back != unknown[i]
        return learnt

    def _text(self, ids: list[int]) -> str:
        try:
            return "".join([self.plain[x] for x in ids])
        except KeyError:
            texts = self.texts
            data = b"".join([texts[x] for x in ids if x in texts])
        try:
            return data.decode()
        except UnicodeDecodeError:
            # Each byte that is part of no character becomes one sign of replacement.
            return data.decode("utf-8", "surrogateescape").translate(_LOST)

    def runs(self, text: str) -> list[str]:
        """Runs of marks with what follows them, each without its first mark."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in _RUN.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text, how many ids it has, the ids in decimal joined by commas, and the
        decoded text, both compared with the library's. The new runs of some texts are encoded
        together."""
        for some in _together(texts):
            expected = self.library.encode(some, return_type="numpy", num_threads=1)
            back = self.library.decode(expected, num_threads=1)
            for text, (found, plain), ids, theirs in zip(some, self._known(some), expected, back):
                own = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), dtype="<u4")
                if own.tobytes() != ids.astype("<u4").tobytes():
                    raise ValueError(f"the encoder differs from the library on {text[:200]!r}")
                # Characters never reach over runs, so decoded runs add up to the decoded text, and
                # pieces that are no bytes to their run.
                decoded = plain.replace(MARK, " ")
                if decoded != theirs:
                    raise ValueError(f"the decoder differs from the library on {text[:200]!r}")
                yield len(own), ",".join(self.decimal[own].tolist()), decoded

    def encode(self, text: str) -> list[int]:
        ids = next(self.encode_texts([text]))[1]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids have none, and one blank at the start goes."""
        return self._text(ids).removeprefix(" ")


def _together(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts: `TOGETHER` at most, and one text or no more than `CHARACTERS`."""
    some, size = [], 0
    for text in texts:
        if some and (len(some) == TOGETHER or size + len(text) > CHARACTERS):
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _points(ids: np.ndarray | list[int]) -> str:
    """Ids as the code points of a text, which is short and joined and compared as a whole."""
    return np.asarray(ids, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")


#: What "surrogateescape" makes of lone bytes.
_LOST = {0xDC00 + b: "\ufffd" for b in range(128, 256)}

_OPENED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _OPENED:
        _OPENED[path] = Pieces(path)
    return _OPENED[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each whole text, decoded again; null texts count as empty.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip (the decoded text is the
    text). Rows are encoded one by one: repeated rows give equal results, an empty table none,
    and further columns are ignored.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = pieces_of(path)
        for batch in batches:
            out = []
            texts = batch["text"].tolist()
            for text, (n, ids, back) in zip(texts, encoder.encode_texts(texts)):
                out.append((n, hashlib.sha256(ids.encode()).hexdigest(),
                            hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            frame = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(
        run, "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING, round_trip BOOLEAN")
