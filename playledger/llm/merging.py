"""Agendas of adjacent symbol pairs for many short words at once.

All words lie in one array of symbols. Every adjacent pair of a word that can be joined has a
priority; in each step the best pair of every word is joined (the first, if tied) and the two
pairs beside it get new priorities. A word whose agenda is empty is done and leaves the array.
"""

from __future__ import annotations

import numpy as np

_NEVER = np.int64(1) << 62
_STIR = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Priority (small first) and joined symbol of pairs of symbols, as an open-addressed table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, priority: np.ndarray, joined: np.ndarray,
                 symbols: int):
        self.symbols = np.int64(symbols)
        keys = left.astype(np.int64) * self.symbols + right
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.priority = np.full(1 << bits, _NEVER, dtype=np.int64)
        self.joined = np.zeros(1 << bits, dtype=np.int64)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        self.probes = 1
        while len(todo):
            free = self.keys[slot] == -1
            place, first = np.unique(slot[free], return_index=True)
            own = todo[free][first]
            self.keys[place], self.priority[place], self.joined[place] = keys[own], priority[own], joined[own]
            waits = self.keys[slot] != keys[todo]
            todo, slot = todo[waits], (slot[waits] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _STIR) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Priorities (a huge number for pairs that can't be joined) and joined symbols."""
        keys = left * self.symbols + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slots(keys)
        hit = self.keys[slot] == keys
        for _ in range(self.probes):
            lost = np.flatnonzero(~hit & (self.keys[slot] != -1))
            if not len(lost):
                break
            slot[lost] = (slot[lost] + 1) & self.mask
            hit[lost] = self.keys[slot[lost]] == keys[lost]
        return np.where(hit, self.priority[slot], _NEVER), np.where(hit, self.joined[slot], -1)


def merge_words(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all words, in order, and how many each has. No word may be empty."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    names = np.arange(len(lengths))
    symbols, lengths = symbols.astype(np.int64), np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    priority, joined = np.full(len(symbols), _NEVER), np.full(len(symbols), -1, dtype=np.int64)
    if len(symbols) > 1:
        priority[:-1], joined[:-1] = pairs.find(symbols[:-1], symbols[1:])
        priority[ends - 1] = _NEVER
    while len(names):
        starts = ends - lengths
        # A place in its word breaks ties; words are far shorter than 2**20.
        place = np.arange(len(symbols)) - np.repeat(starts, lengths)
        order = np.minimum((priority << 20) + place, _NEVER) if len(symbols) else priority
        order = np.where(priority == _NEVER, _NEVER, order)
        best = np.minimum.reduceat(order, starts)
        done = best == _NEVER
        if done.any():
            gone = np.repeat(done, lengths)
            out.append((names[done], lengths[done], symbols[gone]))
            keep = ~gone
            symbols, priority, joined = symbols[keep], priority[keep], joined[keep]
            names, lengths, best = names[~done], lengths[~done], best[~done]
            if not len(names):
                break
            starts = np.cumsum(lengths) - lengths
        at = starts + (best & ((1 << 20) - 1))
        symbols[at] = joined[at]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))  # one symbol of every earlier word has gone
        symbols, priority, joined = symbols[keep], priority[keep], joined[keep]
        lengths = lengths - 1
        ends = np.cumsum(lengths)
        starts = ends - lengths
        for spot, inside in ((at, at + 1 < ends), (at - 1, at > starts)):
            spot = spot[inside]
            priority[spot], joined[spot] = pairs.find(symbols[spot], symbols[spot + 1])
        last = at[at + 1 == ends]
        priority[last] = _NEVER
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = np.concatenate([o[0] for o in out])
    lengths = np.concatenate([o[1] for o in out])
    flat = np.concatenate([o[2] for o in out])
    order = np.argsort(names)
    starts = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    index = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return flat[index], lengths
