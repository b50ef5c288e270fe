"""Spelling variants by a trie of letter counts.

Letters fall into sixteen groups. A word's vector says how many letters of each group it has;
words are arranged in a trie by these counts, one level per group. One inserted letter adds one
to one count, a deleted one takes one away, a replaced one does both or neither. So the words
near another lie where a depth-first search arrives that spends one surplus and one deficit at
most; the words in the leaves it reaches are verified letter by letter.

The first six levels deal the trie to tasks. A word searches its own subtree and those later
ones in reach, so each pair is met once. Large subtrees are searched in tiles: a task holds one
block of a subtree's words and one block of searching words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

GROUPS = 16
#: Levels of the trie that name a subtree; counts in the name take ten bits.
TOP = 6
_BITS, _MOST = 10, 1023
#: Words, and searching words, of a subtree in one tile.
TILE = 8192
#: Rows of whole tiles that are searched together.
TOGETHER = 20_000
#: Entries of the search that go on together, and pairs that are verified together.
WIDE = 100_000
#: Longer words are verified one pair at a time.
LONG = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_every: int = 31,
                least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word and n (occurrences) of the Latin letter runs of whole texts.

    Runs are lower-cased (A-Z only). If `drop_every` divides the crc32 of id and run, the run
    loses a letter, which puts spelling variants into any text. Null texts have no runs and a
    null id counts as empty. Words of fewer letters or occurrences don't count.
    """
    # A run of fewer letters can't become a word, and a greedy match is a whole run.
    found = F.regexp_extract_all(F.col(text), F.lit("([A-Za-zÀ-ÿ]{%d,})" % least_length), F.lit(1))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(found).alias("run"))
    runs = runs.select("key", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "key", "run").cast("binary"))
    at = (F.pmod(F.col("h"), F.length("run"))).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.withColumn("h", h).select(
        F.when(F.pmod(F.col("h"), F.lit(drop_every)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_count))


# -- letters ------------------------------------------------------------------------------

def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, and how many each word has."""
    if not len(words):
        return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
    # The letters of all words lie one after another in the column's buffer.
    words = words.cast(pa.string())
    _, offsets, letters = words.buffers()
    first, last = np.frombuffer(offsets, dtype=np.int32)[[words.offset, words.offset + len(words)]]
    text = str(memoryview(letters or b"")[first:last], "utf-8")
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), pc.utf8_length(words).to_numpy().astype(np.int64)


def _vectors(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of the letter groups, one row per word."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(rows * GROUPS + codes % GROUPS, minlength=len(lengths) * GROUPS).reshape(-1, GROUPS)


def _name(counts: np.ndarray) -> np.ndarray:
    """Subtree names of rows of `TOP` counts; they sort like the counts."""
    name = np.zeros(len(counts), dtype=np.int64)
    for level in range(TOP):
        name = (name << _BITS) | counts[:, level]
    return name


def _reach() -> np.ndarray:
    """Changes of the first counts by one surplus and one deficit at most that lead on in order."""
    eye = np.eye(TOP, dtype=np.int64)
    steps = [np.zeros(TOP, dtype=np.int64)] + [*eye] + [-e for e in eye]
    steps += [eye[i] - eye[j] for i in range(TOP) for j in range(TOP) if i != j]
    return np.array([s for s in steps if tuple(s) >= (0,) * TOP])


_ROWS = "subtree BIGINT, own BOOLEAN, word STRING, n BIGINT"
_ROWS_ARROW = pa.schema([("subtree", pa.int64()), ("own", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])


def _searching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word for its own subtree and for every later one in reach."""
    steps = _reach()
    for batch in batches:
        for start in range(0, len(batch), 2048):
            some = batch.slice(start, 2048)
            top = np.minimum(_vectors(*_codes(some["word"]))[:, :TOP], _MOST)
            for step in steps:
                to = top + step
                # A count that is cut in the name does not grow there: the other steps meet it.
                possible = np.flatnonzero(((to >= 0) & (to <= _MOST)).all(axis=1))
                rows = some.take(pa.array(possible))
                yield pa.record_batch([
                    pa.array(_name(to[possible])), pa.array(np.full(len(rows), not step.any())),
                    rows["word"], rows["n"]], schema=_ROWS_ARROW)


# -- the search ---------------------------------------------------------------------------

class _Trie:
    """Words of several tiles, sorted by tile and vector; a node is a range of them."""

    def __init__(self, tile: np.ndarray, vectors: np.ndarray):
        self.order = np.lexsort((*vectors.T[::-1], tile))
        tile, vectors = tile[self.order], vectors[self.order]
        self.base = int(vectors.max(initial=0)) + 3
        new = np.append(True, tile[1:] != tile[:-1])
        node = np.cumsum(new) - 1
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(tile)) - 1
        self.tiles, self.top = tile[new], vectors[first, :TOP]
        self.keys = []
        for level in range(GROUPS):
            key = node * self.base + vectors[:, level]
            new = np.append(True, key[1:] != key[:-1])
            self.keys.append(key[new])
            node = np.cumsum(new) - 1
            if level == TOP - 1:
                # Words of a subtree have the same first counts, unless its name cuts a count.
                self.below, self.single = node[first], node[first] == node[last]
        self.starts = np.append(np.flatnonzero(new), len(tile))

    def search(self, tile: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(searching row, row of the trie) of all leaf words in reach, depth first in wide steps."""
        node = np.minimum(np.searchsorted(self.tiles, tile), len(self.tiles) - 1)
        rows = np.flatnonzero(self.tiles[node] == tile)
        node = node[rows]
        # The subtree's first counts are known, and with them what a search has spent there.
        change = self.top[node] - vectors[rows, :TOP]
        surplus, deficit = 1 - np.maximum(change, 0).sum(axis=1), 1 + np.minimum(change, 0).sum(axis=1)
        single = self.single[node]
        begin = [(0, ~single, node, 1, 1)] + [
            (TOP, single & (surplus == up) & (deficit == down), self.below[node], up, down)
            for up in (0, 1) for down in (0, 1)]
        stack, leaves, waiting = [], [], 0
        for level, own, at, up, down in begin:
            own_rows, own_node = rows[own], at[own]
            stack += [(level, own_rows[i:i + WIDE], own_node[i:i + WIDE], up, down)
                      for i in range(0, len(own_rows), WIDE)]
        while stack:
            level, rows, node, surplus, deficit = stack.pop()
            if level == GROUPS:
                leaves.append((rows, node))
                waiting += len(rows)
                if waiting >= WIDE:
                    yield from self._leaves(leaves)
                    leaves, waiting = [], 0
                continue
            keys, wanted = self.keys[level], node * self.base + vectors[rows, level]
            counts = vectors[rows, level]
            for step, left in ((0, (surplus, deficit)), (1, (surplus - 1, deficit)), (-1, (surplus, deficit - 1))):
                if min(left) < 0:
                    continue
                child = np.searchsorted(keys, wanted + step)
                there = keys[np.minimum(child, len(keys) - 1)] == wanted + step
                # A count of the search may be larger than any in the trie.
                there &= (counts + step >= 0) & (counts + step < self.base)
                if there.any():
                    stack.append((level + 1, rows[there], child[there], *left))
        if leaves:
            yield from self._leaves(leaves)

    def _leaves(self, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows, node = (np.concatenate(x) for x in zip(*found))
        first, size = self.starts[node], self.starts[node + 1] - self.starts[node]
        ends = np.cumsum(size)
        at, total = 0, int(ends[-1])
        while at < total:
            pair = np.arange(at, min(at + WIDE, total))
            own = np.searchsorted(ends, pair, side="right")
            yield rows[own], self.order[first[own] + pair - (ends[own] - size[own])]
            at += WIDE


class _Letters:
    """Words as rows of code points, from the left and from the right."""

    def __init__(self, words: pa.Array, codes: np.ndarray, lengths: np.ndarray):
        self.words, self.lengths = words, lengths
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        back = np.repeat(lengths, lengths) - 1 - place
        # As narrow as the words allow.
        width, kind = min(LONG, int(lengths.max(initial=0))) + 1, np.uint16 if codes.max(initial=0) < 0xFFFF else np.uint32
        self.left = np.zeros((len(lengths), width), dtype=kind)
        self.right = np.zeros((len(lengths), width), dtype=kind)
        for matrix, at in ((self.left, place), (self.right, back)):
            fits = at < LONG
            matrix[row[fits], at[fits]] = (codes[fits] + np.uint32(1)).astype(kind)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs that differ by exactly one inserted, deleted or replaced code point."""
        longest = np.maximum(self.lengths[a], self.lengths[b])
        shortest = np.minimum(self.lengths[a], self.lengths[b])
        same = []
        for matrix in (self.left, self.right):
            differs = matrix[a] != matrix[b]
            first = differs.argmax(axis=1)
            first[~differs[np.arange(len(first)), first]] = LONG + 1
            same.append(np.minimum(first, shortest))
        found = (same[0] + same[1] >= longest - 1) & (longest - shortest <= 1) & (same[0] < longest)
        for i in np.flatnonzero(longest > LONG):
            found[i] = one_apart(self.words[a[i]].as_py(), self.words[b[i]].as_py())
        return found


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one word the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:]
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i:]


_PAIRS = "a STRING, n_a BIGINT, b STRING, n_b BIGINT"
_PAIRS_ARROW = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])
_TILE = ("subtree", "block", "search")


def _searched(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near pairs of the whole tiles in `rows`."""
    rows = rows.combine_chunks()
    ids = [rows[c].to_numpy() for c in _TILE]
    changed = np.zeros(len(rows), dtype=np.int64)
    for column in ids:
        changed[1:] |= column[1:] != column[:-1]
    tile = np.cumsum(changed)
    words, n = rows["word"].chunk(0), rows["n"].chunk(0)
    vectors = _vectors(*_codes(words))
    asks = rows["asks"].to_numpy()
    own = rows["own"].to_numpy()
    member, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    if not len(member) or not len(asking):
        return
    trie = _Trie(tile[member], vectors[member])
    for at, to in trie.search(tile[asking], vectors[asking]):
        # Most searching words reach no leaf: letters are laid out for those that do.
        a, b = asking[at], member[to]
        used = np.zeros(len(words), dtype=bool)
        used[a] = used[b] = True
        met, place = np.flatnonzero(used), np.cumsum(used) - 1
        some = words.take(pa.array(met))
        a, b = place[a], place[b]
        close = _Letters(some, *_codes(some)).near(a, b)
        a, b = met[a[close]], met[b[close]]
        first, second = words.take(pa.array(a)), words.take(pa.array(b))
        # Within a subtree both words of a pair search: the first in order counts.
        once = ~own[a] | pc.less(first.cast(pa.binary()), second.cast(pa.binary())).to_numpy(zero_copy_only=False)
        keep = pa.array(np.flatnonzero(once))
        if len(keep):
            yield pa.record_batch([first.take(keep), n.take(pa.array(a)).take(keep), second.take(keep),
                                   n.take(pa.array(b)).take(keep)], schema=_PAIRS_ARROW)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole tiles, some at a time, searched."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size < TOGETHER:
            continue
        rows = pa.Table.from_batches(waiting)
        last = np.zeros(len(rows), dtype=bool)
        for c in _TILE:
            column = rows[c].to_numpy()
            last |= column != column[-1]
        cut = int(last.sum())  # sorted: rows of the last tile stand at the end
        if cut:
            yield from _searched(rows.slice(0, cut))
        waiting = rows.slice(cut).combine_chunks().to_batches()
        size = len(rows) - cut
    if size:
        yield from _searched(pa.Table.from_batches(waiting))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every pair of near words once. `words`: distinct words and their n."""
    rows = words.select("word", "n")
    searching = rows.mapInArrow(_searching, _ROWS)
    # A word's own subtree is where it is a member.
    member = searching.where("own")
    sizes = member.groupBy("subtree").agg(F.count("*").alias("members")).join(
        searching.groupBy("subtree").agg(F.count("*").alias("asking")), "subtree")
    blocks = sizes.select("subtree", F.ceil(F.col("members") / TILE).cast("int").alias("blocks"),
                          F.ceil(F.col("asking") / TILE).cast("int").alias("searches"))

    def dealt(side: DataFrame, own: str, other: str, own_name: str, other_name: str, asks: bool) -> DataFrame:
        """Each row in one block of its side, for all blocks of the other."""
        own_block: Column = F.pmod(F.xxhash64("word"), F.col(own)).cast("int")
        return side.join(blocks, "subtree").select(
            "subtree", own_block.alias(own_name), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name),
            F.lit(asks).alias("asks"), "own", "word", "n")

    both = dealt(member, "blocks", "searches", "block", "search", False).unionByName(
        dealt(searching, "searches", "blocks", "search", "block", True))
    return both.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(_tiles, _PAIRS)


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with their number n of occurrences.

    A word's form is the near word of largest n (ties: first by code points) if that is ten times
    the word's own or more; its root is where forms lead to. Null words are left out; an empty
    table gives no rows; further columns are ignored. Words may be of any length: those above
    `LONG` letters are verified one by one. No word meets all others: tiles bound what a task
    holds, and the trie what it compares.
    """
    rows = stored(words.where("word IS NOT NULL").select("word", F.col("n").cast("bigint").alias("n")))
    each = near_pairs(rows).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))).alias("p")).select("p.*")
    best = each.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= 10 * F.col("n")
    found = stored(rows.join(best, "word", "left").select(
        "word", F.when(strong, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n")))
    drop_stored(rows)
    return found.join(roots(found.where("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where following forms ends. Each round doubles the steps that are taken; n
    grows tenfold with every step, so there are at most eighteen steps and five rounds."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        # Roots with no form of their own are where the steps end.
        moved = stored(at.join(on, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), "_further"))
        drop_stored(at)
        at = moved.select("word", "root")
        if moved.where("_further IS NOT NULL").isEmpty():
            break
    return at
