"""Near-duplicates by set sketches: exponentially spaced registers, likelihood, exact check.

A document's set holds its distinct shingles of five words (a shorter text is one shingle).
1. Equal sets become one node, so exact copies cost one row afterwards.
2. A node's sketch has `REGISTERS` registers. Register i holds the smallest of exponentially
   distributed hash values of the set, rounded down on a logarithmic scale of base `BASE` and
   cut to 16 bits. Registers of a union are the larger registers of its parts.
3. Four registers in a row are a band. Nodes that share a band are candidates: two sets of
   similarity 0.75 share none of the 40 bands with a probability below 3e-7.
4. Candidates are compared by the likelihood of their registers' order, given both set
   sizes. Those whose best similarity is below `LIKELY` go (five standard errors below 0.75).
5. What is left is grouped into connected candidates, and within each group full sets are
   compared. Groups above two blocks are compared block by block.
Large buckets and groups give back spanning links only, never all their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .components import connected_components
from .wordhash import shingle_set, word_hashes

REGISTERS, BASE, RATE, ROWS = 256, 1.001, 20.0, 4
#: Bands that are compared, of the 64 that all registers make.
BANDS = 40
LIKELY = 0.62
#: Buckets up to this size list their pairs (so each member has fewer partners than this).
SMALL = 24
#: Members of one block of a large group, and of either side in a task of a large bucket.
BLOCK, SIDE = 64, 2048
#: Bits for each key that rows are looked up by before they are shuffled, and all bits at most.
SPARE, MOST_BITS = 16, 1 << 28

_draw = np.random.default_rng(20240917)
_FACTOR = _draw.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _draw.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes as 16-bit registers; 0 for an empty set."""
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    if not len(hashes):
        return np.zeros(REGISTERS, dtype=np.uint16)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    short ^= hashes.astype(np.uint32)
    for at in range(0, len(short), 512):
        block = short[at:at + 512, None] * _FACTOR
        block += _SHIFT
        np.minimum(least, block.min(axis=0), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(left, right)


def _likelihood(larger: np.ndarray, smaller: np.ndarray, share: np.ndarray,
                similarity: np.ndarray) -> np.ndarray:
    step = (BASE - 1) / BASE
    log = np.log(BASE)
    over = -np.log1p(-np.maximum(share - (1 - share) * similarity, 1e-12) * step) / log
    under = -np.log1p(-np.maximum((1 - share) - share * similarity, 1e-12) * step) / log
    even = np.maximum(1 - over - under, 1e-12)
    return larger * np.log(over) + smaller * np.log(under) + (REGISTERS - larger - smaller) * np.log(even)


def estimated(larger: np.ndarray, smaller: np.ndarray, left: np.ndarray,
              right: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, from how many registers of the left set are larger and
    smaller than the right's, and both set sizes. Golden-section search on all pairs at once."""
    left, right = np.asarray(left, dtype=float), np.asarray(right, dtype=float)
    share = left / np.maximum(left + right, 1)
    low = np.zeros_like(share)
    high = np.minimum(left, right) / np.maximum(np.maximum(left, right), 1)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(18):
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        up = _likelihood(larger, smaller, share, x) < _likelihood(larger, smaller, share, y)
        low, high = np.where(up, x, low), np.where(up, high, y)
    return (low + high) / 2


def _sizes_fit(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(left, right) >= percent * np.maximum(left, right)


def sketches(docs: DataFrame) -> DataFrame:
    """(row columns doc_id, text_key), set_key, n_shingles and the bands as 64-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, counts, bands = [], [], []
            for words in word_hashes(batch["text"].tolist()):
                own = shingle_set(words)
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                counts.append(len(own))
                bands.append(registers(own).view(np.int64) if len(own) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"],
                                "set_key": keys, "n_shingles": counts, "bands": bands})

    return _keyed(docs).mapInPandas(
        run, "doc_id BIGINT, text_key BINARY, set_key BINARY, n_shingles BIGINT, bands ARRAY<BIGINT>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
        F.unhex(F.md5(text.cast("binary"))).alias("text_key"))


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of an undirected graph given as a square boolean matrix."""
    n = len(links)
    free = np.ones(n, dtype=bool)
    out = []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        wave = [root]
        while wave:
            at = wave.pop()
            found = np.flatnonzero(links[at] & free)
            free[found] = False
            out += [(at, int(x)) for x in found]
            wave += found.tolist()
    return out


def _tiles(members: DataFrame, group: str, size: str) -> DataFrame:
    """Each member once for every pair of blocks that its own block is part of.

    Groups up to two blocks are one tile. Others have ceil(size / BLOCK) blocks."""
    blocks = F.when(F.col(size) <= 2 * BLOCK, 1).otherwise(F.ceil(F.col(size) / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("_blocks")).cast("int")
    return (
        members.withColumn("_blocks", blocks).withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_tile", F.concat_ws(",", F.least("_own", "_other"), F.greatest("_own", "_other")))
        .drop("_blocks", "_other")
    )


def _likely_in_bucket(percent: int):
    """One of a large bucket's blocks against a block of its members outside its main group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["_asks"].to_numpy()
        own = np.stack(rows["bands"].to_numpy()).astype(np.int64).view(np.uint16).reshape(len(rows), REGISTERS)
        count, node, group = (rows[c].to_numpy() for c in ("n_shingles", "node", "group"))
        block, out = np.flatnonzero(~asks), []
        # Of two members that both ask, the larger node does.
        main = rows["_main"].to_numpy() == group
        for i in np.flatnonzero(asks):
            x = block[(group[block] != group[i]) & (main[block] | (node[block] < node[i]))
                      & _sizes_fit(count[block], count[i], percent)]
            # Similarity is close to the share of equal registers; below a half it can't be likely.
            x = x[(own[x] == own[i]).sum(axis=1) >= REGISTERS // 2]
            if not len(x):
                continue
            size = np.full(len(x), count[i])
            near = estimated((own[i] > own[x]).sum(axis=1), (own[i] < own[x]).sum(axis=1), size, count[x])
            out += [(node[i], n) for n in _one_of_each(node[x], group[x], near)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _one_of_each(node: np.ndarray, group: np.ndarray, near: np.ndarray) -> list[int]:
    """The likely nodes, one of each group: a group is linked already."""
    likely = near >= LIKELY
    return node[likely][np.unique(group[likely], return_index=True)[1]].tolist()


def _likely_pairs(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (
                np.stack(batch[c].to_numpy()).astype(np.int64).view(np.uint16).reshape(-1, REGISTERS)
                for c in ("bands_a", "bands_b"))
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            near = estimated((left > right).sum(axis=1), (left < right).sum(axis=1), n_a, n_b)
            yield batch.loc[(near >= LIKELY) & _sizes_fit(n_a, n_b, percent), ["a", "b"]]

    return run


def candidate_links(nodes: DataFrame, percent: int = 75) -> DataFrame:
    """Links (a, b) that connect all nodes which may be near; `nodes`: node, n_shingles, bands.

    First every member of a bucket is compared with the bucket's first node. Most buckets then
    lie in one group of linked nodes, where no further pair can join anything. In the others,
    members of different groups are compared with each other.
    """
    banded = nodes.where("n_shingles > 0").select(
        "node", "n_shingles", F.posexplode(F.slice("bands", 1, BANDS)).alias("band", "value"))
    crowded = banded.groupBy("band", "value").agg(
        F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1")
    members = stored(banded.join(crowded, ["band", "value"]))
    written: list[DataFrame] = []
    sketch = nodes.select("node", "n_shingles", "bands")

    def likely(pairs: DataFrame) -> DataFrame:
        # Written first, so that few pairs are known to be few and sketches stay where they are.
        pairs = stored(pairs)
        written.append(pairs)
        both = pairs.join(
            sketch.withColumnsRenamed({"node": "a", "n_shingles": "n_a", "bands": "bands_a"}), "a"
        ).join(sketch.withColumnsRenamed({"node": "b", "n_shingles": "n_b", "bands": "bands_b"}), "b")
        return both.mapInPandas(_likely_pairs(percent), "a BIGINT, b BIGINT")

    first = stored(likely(members.where("node <> hub").select(
        F.col("hub").alias("a"), F.col("node").alias("b")).distinct()))
    groups = connected_components(first).withColumnRenamed("component", "group")
    placed = stored(members.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node")))
    drop_stored(members)
    mixed = placed.groupBy("band", "value").agg(
        F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low < _high").select("band", "value")
    rest = stored(placed.join(mixed, ["band", "value"]))
    drop_stored(placed)
    small = rest.where(F.col("size") <= SMALL)
    left = small.select(
        "band", "value", "hub", F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("group").alias("g_a"))
    right = small.select(
        "band", "value", F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("group").alias("g_b"))
    pairs = left.join(right, ["band", "value"]).where(
        (F.col("a") < F.col("b")) & (F.col("g_a") != F.col("g_b")) & (F.col("a") != F.col("hub"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    ).select("a", "b").distinct()
    large = rest.where(F.col("size") > SMALL)
    main = large.groupBy("band", "value", "group").agg(F.count("*").alias("_n")).groupBy("band", "value").agg(
        F.max_by("group", "_n").alias("_main"), F.max("_n").alias("_in_main"))
    # Both sides are dealt to blocks: each block meets each block of those outside the main group.
    in_main = stored(large.join(main, ["band", "value"]))
    marked = in_main.join(sketch.select("node", "bands"), "node").withColumn(
        "_blocks", F.ceil(F.col("size") / SIDE).cast("int")).withColumn(
        "_askers", F.ceil((F.col("size") - F.col("_in_main")) / SIDE).cast("int"))

    def dealt(rows: DataFrame, asks: bool) -> DataFrame:
        own, other = ("_askers", "_blocks") if asks else ("_blocks", "_askers")
        placed = rows.withColumn("_own", F.pmod(F.xxhash64("node", F.lit(7)), F.col(own)).cast("int")).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        first, second = ("_other", "_own") if asks else ("_own", "_other")
        return placed.withColumn("_block", F.col(first)).withColumn("_asker", F.col(second)).withColumn(
            "_asks", F.lit(asks)).drop("_own", "_other", "_blocks", "_askers", "_in_main")

    in_large = dealt(marked, False).unionByName(dealt(marked.where(F.col("group") != F.col("_main")), True)).groupBy(
        "band", "value", "_block", "_asker").applyInPandas(_likely_in_bucket(percent), "a BIGINT, b BIGINT")
    links = stored(first.unionByName(likely(pairs)).unionByName(in_large))
    for gone in (first, rest, in_main, *written):
        drop_stored(gone)
    return links


def _exact_links(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        sets = [shingle_set(w) for w in word_hashes(rows["text"].tolist())]
        count = np.array([len(s) for s in sets], dtype=np.int64)
        n = len(sets)
        if n < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if n <= 6:
            both = np.zeros((n, n))
            for i in range(n - 1):
                for j in range(i + 1, n):
                    if _sizes_fit(count[i], count[j], percent):
                        both[i, j] = both[j, i] = len(
                            np.intersect1d(sets[i], sets[j], assume_unique=True))
        else:
            both = _intersections(sets)
        links = 100 * both >= percent * (count[:, None] + count[None, :] - both)
        np.fill_diagonal(links, False)
        pairs = _forest(links)
        return pd.DataFrame({"a": [node[i] for i, _ in pairs], "b": [node[j] for _, j in pairs]},
                            dtype="int64")

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices of the shared hashes."""
    n = len(sets)
    hashes = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    fresh = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((n, n))
    width = 8192
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [at, at + width]))
        matrix = np.zeros((n, width), dtype=np.float32)
        matrix[owner[part], column[part] - at] = 1
        both += matrix @ matrix.T
    return both


def _may_be_among(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are among those of `chosen`, and one in `SPARE` of the others at most.

    A bit is set for the hash of each chosen key. The bits are broadcast in words of 64, in size
    by the number of chosen rows; above `MOST_BITS` more of the other rows pass. A join by the
    keys follows: this only keeps rows that it would drop out of its shuffle.
    """
    bits = min(max(1 << (SPARE * chosen.count()).bit_length(), 64), MOST_BITS)
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    word, bit = F.shiftright(at, 6).alias("_word"), at.bitwiseAND(F.lit(63)).cast("int").alias("_bit")
    words = chosen.select(word, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    return rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word").where(
        F.getbit("_bits", "_bit") == 1).drop("_word", "_bit", "_bits")


def _components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and set_key, n_shingles, least_id, component of each set."""
    rows = stored(sketches(docs))
    key_less = F.coalesce("doc_id", F.lit(-(1 << 63)))
    nodes = stored(
        rows.where("n_shingles > 0").groupBy("set_key", "n_shingles").agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct(key_less.alias("id"), "text_key")).alias("source"),
            F.min_by("bands", F.struct(key_less, "text_key")).alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    # Sketches are kept once, with the nodes.
    sketched, rows = rows, stored(rows.drop("bands"))
    drop_stored(sketched)
    maybe = connected_components(candidate_links(nodes, percent))
    sizes = maybe.groupBy("component").agg(F.count("*").alias("size"))
    # Written first, so that texts that are not wanted can be left out before the shuffle.
    wanted = stored(
        maybe.join(sizes, "component")
        .join(nodes.select("node", F.col("source.id").alias("id"), F.col("source.text_key").alias("text_key")), "node")
    )
    texts = (
        _may_be_among(_keyed(docs).withColumn("id", key_less).drop("doc_id"), wanted, ["id", "text_key"])
        .join(wanted, ["id", "text_key"])
        .select("node", "component", "size", "text")
    )
    links = _tiles(texts, "component", "size").groupBy("component", "_tile").applyInPandas(
        _exact_links(percent), "a BIGINT, b BIGINT")
    joined = connected_components(links)
    return rows, nodes.join(joined, "node", "left").select(
        "set_key", "n_shingles", "least_id", F.coalesce("component", "node").alias("component"))


def text_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(text_key, component) of every distinct text that has shingles, whatever its ids."""
    rows, named = _components(docs, percent)
    texts = rows.where("n_shingles > 0").select("text_key", "set_key").distinct()
    return texts.join(named.select("set_key", "component"), "set_key").select("text_key", "component")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, further columns ignored).

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links of at
    least `percent` / 100 Jaccard similarity, itself included) and kept (doc_id equals it).
    Null, empty and blank texts have no shingles and are linked with nothing: each is its own
    component. A null doc_id never names a component; a component that holds only such rows
    has a null component_id and keeps none by that name (kept is then true for every row).
    Rows that repeat a doc_id are rows of their own; equal ones are all kept. An empty table
    gives no rows.
    """
    rows, named = _components(docs, percent)
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = named.join(least, "component").select("set_key", "component_id")
    # The join, not a window, spreads a set that a large part of all rows share.
    found = rows.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
