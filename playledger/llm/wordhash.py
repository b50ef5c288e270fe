"""64-bit hashes of words and of word shingles, computed on byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A-Z to a-z; tab, line feed, vertical tab, form feed and carriage return to a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)
)
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_PIECE = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_PRIME, _PIECE + 1), _powers(_INVERSE, _PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3AAACE3F4F91E4D)
    return x ^ (x >> np.uint64(32))


def _hash_buffer(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a folded buffer, and where each starts."""
    codes = np.frombuffer(data, dtype=np.uint8)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = (_UP, _DOWN) if n <= _PIECE else (_powers(_PRIME, n), _powers(_INVERSE, n))
    word = np.zeros(n + 2, dtype=np.int8)
    word[1:-1] = codes != 32
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long buffer in pieces that end at blanks."""
    at = 0
    while len(data) - at > _PIECE:
        cut = data.rfind(b" ", at, at + _PIECE)
        if cut <= at:
            cut = data.find(b" ", at + _PIECE)
            if cut < 0:
                break
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words in order.

    Words are runs without blanks and without the characters 9 to 13; A-Z are lower-cased.
    Short texts share one buffer.
    """
    waiting: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _hash_buffer(b" ".join(waiting))
        bounds = np.cumsum([0] + [len(d) + 1 for d in waiting])
        cuts = np.searchsorted(starts, bounds)
        for i in range(len(waiting)):
            yield hashes[cuts[i]:cuts[i + 1]]

    for text in texts:
        data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
        if size + len(data) + 1 > _PIECE and waiting:
            yield from flush()
            waiting, size = [], 0
        if len(data) > _PIECE:
            yield np.concatenate([_hash_buffer(p)[0] for p in _pieces(data)])
        else:
            waiting.append(data)
            size += len(data) + 1
    if waiting:
        yield from flush()


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; a shorter text is one run."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(_PRIME) + words[i:n - width + 1 + i]
    return np.unique(mix(out))
