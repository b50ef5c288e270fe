"""Exact top-k by integer inner product, in three phases with a uniform threshold.

Components are cut into lists; a list holds, for a query, the partial products of all
vectors over its components, lifted by the list's smallest so that none is negative.
1. Every list gives its best entries. The k-th best of the sums of what was given is a safe
   lower bound of the k-th best whole score.
2. An entry below bound / lists in every list can't reach the bound. Of the entries that reach
   this cutoff, a task, which holds all lists of its block, adds up the parts and gives the
   k + 1 best that reach the bound, ties by id.
3. Whole scores of those that reach a sharper bound, from all blocks, are computed exactly.

Equal vectors are one candidate with its k + 1 smallest ids and their repeats, so copies cost
nothing. A query whose id has several vectors doesn't meet those that only its own id has. Queries
and candidates meet in blocks: either side is dealt to groups of bounded size, and every pair
of a query group and a candidate group is one task's work. Each round ships at most k + 1 entries
per query, list and candidate group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LISTS = 2
#: Vectors of a candidate group and of a query group.
CANDIDATES, QUERIES = 4096, 1024


def scaled(embedding: Column | str, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a number of 64 bits; null where the vector is
    null or holds a null or non-finite component."""
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return F.when(column.isNotNull() & ~bad, whole)


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """(number, vector, ids, sole) of each distinct vector: its `ids` smallest different ids, each
    with its repeats (id, n; n is `ids` at most), and the id if it has one only."""
    # Repeats are counted first, and ranks are cut in sub-groups, so that a very common vector is spread.
    counted = vectors.groupBy("vector", "vec_id").agg(F.count("*").alias("_n")).withColumn(
        "_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    cut = counted.withColumn("_rank", F.row_number().over(
        Window.partitionBy("vector", "_salt").orderBy("vec_id"))).where(F.col("_rank") <= ids)
    pair = F.struct(F.col("vec_id").alias("id"), F.least("_n", F.lit(ids)).cast("int").alias("n"))
    grouped = cut.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list(pair)), 1, ids).alias("ids"))
    return grouped.withColumn("number", F.monotonically_increasing_id()).withColumn(
        "sole", F.when(F.size("ids") == 1, F.element_at("ids", 1)["id"]))


def with_own(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """Query rows (vec_id, vector) with own: the id if it has several vectors, else null."""
    hashed = F.xxhash64("vector")
    several = vectors.groupBy("vec_id").agg(F.min(hashed).alias("_a"), F.max(hashed).alias("_b")).where(
        "_a < _b").select("vec_id", F.col("vec_id").alias("own"))
    return asked.join(several, "vec_id", "left")


def own_left_out(ids: Column | str, own: Column | str) -> Column:
    """The ids and repeats without the query's own id, where that is known."""
    ids, own = (F.col(x) if isinstance(x, str) else x for x in (ids, own))
    return F.when(own.isNull(), ids).otherwise(F.filter(ids, lambda x: x["id"] != own))


def usable_pairs(queries: pd.DataFrame, found: pd.DataFrame) -> np.ndarray | None:
    """Which queries may meet which vectors: not those that only their own id has. None: all may."""
    own, sole = (frame[c].astype("Int64") for frame, c in ((queries, "own"), (found, "sole")))
    if own.isna().all() or sole.isna().all():
        return None
    left, right = own.fillna(0).to_numpy(np.int64), sole.fillna(0).to_numpy(np.int64)
    same = left[:, None] == right[None, :]
    return ~(same & own.notna().to_numpy()[:, None] & sole.notna().to_numpy()[None, :])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where that is exact."""
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < 2**53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def _lists(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """Partial products of every list, not lifted."""
    cuts = np.linspace(0, left.shape[1], LISTS + 1).astype(int)
    return [_products(left[:, a:b], right[:, a:b]) for a, b in zip(cuts, cuts[1:])]


def _steps(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, 250_000 // max(1, columns))
    for at in range(0, rows, step):
        yield slice(at, at + step)


def _best(key: tuple, queries: pd.DataFrame, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phase 1: of each list the k best entries and the smallest one."""
    out = []
    if len(queries) and len(found):
        q, c = _matrix(queries["vector"]), _matrix(found["vector"])
        number, query = found["number"].to_numpy(), queries["number"].to_numpy()
        for part in _steps(len(q), len(c)):
            lists = _lists(q[part], c)
            usable = usable_pairs(queries.iloc[part], found)
            for j, partial in enumerate(lists):
                order = -partial if usable is None else np.where(usable, -partial, np.iinfo(np.int64).max)
                top = np.argpartition(order, min(k, len(c)) - 1, axis=1)[:, :k]
                for i in range(len(partial)):
                    own = top[i] if usable is None else top[i][usable[i, top[i]]]
                    out.append((query[part][i], j, int(partial[i].min()), number[own], partial[i, own]))
    return pd.DataFrame(out, columns=["query", "list", "least", "numbers", "partials"])


def _reaching(key: tuple, queries: pd.DataFrame, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phase 2: the k best of the entries that reach the cutoff in a list, with their lifted whole
    scores; ties go to the smallest id that the query may meet. More can't be among the k best of all."""
    out = []
    if len(queries) and len(found):
        q, c = _matrix(queries["vector"]), _matrix(found["vector"])
        number, query = found["number"].to_numpy(), queries["number"].to_numpy()
        least, cutoff, bound = _matrix(queries["least"]), queries["cutoff"].to_numpy(), queries["bound"].to_numpy()
        for part in _steps(len(q), len(c)):
            lifted = [x - least[part][:, j:j + 1] for j, x in enumerate(_lists(q[part], c))]
            over = np.logical_or.reduce([x >= cutoff[part][:, None] for x in lifted])
            whole = sum(lifted)
            over &= whole >= bound[part][:, None]
            usable = usable_pairs(queries.iloc[part], found)
            if usable is not None:
                over &= usable
            for i in range(len(whole)):
                seen = np.flatnonzero(over[i])
                score = whole[i, seen]
                if len(seen) > k:
                    near = score >= np.partition(score, len(score) - k)[len(score) - k]
                    seen, score = seen[near], score[near]
                if len(seen) > k:
                    ids = _first_ids(found.iloc[seen], queries["own"].iloc[part].iloc[i])
                    best = np.lexsort((ids, -score))[:k]
                    seen, score = seen[best], score[best]
                if len(seen):
                    out.append((query[part][i], number[seen], score))
    return pd.DataFrame(out, columns=["query", "numbers", "scores"])


def _first_ids(found: pd.DataFrame, own: int | None) -> np.ndarray:
    """The smallest id of each vector, left out the query's own where that is known."""
    ids = found["ids"]
    if pd.isna(own):
        return np.array([x[0] for x in ids], dtype=np.int64)
    return np.array([next(i for i in x if i != own) for x in ids], dtype=np.int64)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5,
                       lists: int = LISTS) -> DataFrame:
    """The k highest inner products of each query row with all other rows.

    `vectors` has vec_id and vector (array of 64-bit integers); rows with a null in either take
    no part. Returns query_id, rank (from 1), vec_id, score. Ties go to the smaller vec_id.
    Fewer than k other rows give fewer ranks; a query alone gives none. Vectors are compared
    with those of equal length only; empty vectors score 0. Rows that repeat a vec_id are rows
    of their own, but no row meets rows of its own vec_id. Further columns are ignored.
    Products must stay within 64 bits.
    """
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "vector")
    candidates = stored(distinct_vectors(valid, k + 1).withColumn("width", F.size("vector")))
    n_candidates = candidates.count()
    asked = valid.where(is_query).distinct()
    query_rows = stored(with_own(asked, valid).withColumn("width", F.size("vector")))
    queries = stored(
        query_rows.groupBy("vector", "width", "own").agg(F.count("*").alias("_n")).drop("_n")
        .withColumn("number", F.monotonically_increasing_id()))
    n_queries = queries.count()
    c_groups = max(1, -(-n_candidates // CANDIDATES))
    q_groups = max(1, -(-n_queries // QUERIES))

    # The two smallest ids say which comes first for any query.
    dealt = candidates.withColumn("ids", F.slice("ids", 1, 2)["id"]).withColumn("c", F.pmod(F.xxhash64("number"), F.lit(c_groups)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1)))).select(
        "q", "c", "width", "number", "vector", "sole", "ids")

    def grid(frame: DataFrame) -> DataFrame:
        return frame.withColumn("q", F.pmod(F.xxhash64("number"), F.lit(q_groups)).cast("int")).withColumn(
            "c", F.explode(F.sequence(F.lit(0), F.lit(c_groups - 1))))

    wanted = k + 1
    by = ("q", "c", "width")
    given = grid(queries).groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(
        lambda key, a, b: _best(key, a, b, wanted),
        "query BIGINT, list INT, least BIGINT, numbers ARRAY<BIGINT>, partials ARRAY<BIGINT>")
    first = stored(given)
    floor = first.groupBy("query", "list").agg(F.min("least").alias("least"))
    entries = first.select("query", "list", F.explode(F.arrays_zip("numbers", "partials")).alias("e")).join(
        floor, ["query", "list"])
    sums = entries.groupBy("query", F.col("e.numbers").alias("found")).agg(
        F.sum(F.col("e.partials") - F.col("least")).alias("low"))
    best = F.slice(F.sort_array(F.collect_list("low"), asc=False), 1, wanted)
    # At most lists * c_groups * (k + 1) sums per query meet in one row.
    bound = sums.groupBy("query").agg(best.alias("best")).select(
        "query", F.when(F.size("best") >= wanted, F.element_at("best", wanted)).otherwise(0).alias("bound"))
    limits = (
        bound.join(
            floor.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("list", "least"))).alias("_l"))
            .select("query", F.col("_l.least").alias("least")), "query")
        .withColumn("cutoff", F.ceil(F.col("bound") / lists))
    )
    cut = stored(queries.join(limits, queries["number"] == limits["query"]).drop("query"))
    reached = grid(cut).groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(
        lambda key, a, b: _reaching(key, a, b, wanted),
        "query BIGINT, numbers ARRAY<BIGINT>, scores ARRAY<BIGINT>")
    second = stored(reached.select("query", F.explode(F.arrays_zip("numbers", "scores")).alias("e")).select(
        "query", F.col("e.numbers").alias("found"), F.col("e.scores").alias("lifted")))
    # At most c_groups * (k + 1) entries per query meet in one row.
    sharper = second.groupBy("query").agg(
        F.slice(F.sort_array(F.collect_list("lifted"), asc=False), 1, wanted).alias("best")).select(
        "query", F.when(F.size("best") >= wanted, F.element_at("best", wanted)).otherwise(0).alias("sharp"))
    still = second.join(sharper, "query").where(F.col("lifted") >= F.col("sharp")).select("query", "found")
    whole = (
        still.join(queries.select(F.col("number").alias("query"), F.col("vector").alias("_q"), "own"), "query")
        .join(candidates.select(F.col("number").alias("found"), F.col("vector").alias("_c"), "ids"), "found")
        .withColumn("score", F.aggregate(
            F.zip_with("_q", "_c", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x))
        .select("query", "score", own_left_out("ids", "own").alias("ids"))
    )
    return _ranked(whole, query_rows, queries, k)


def _ranked(scored: DataFrame, query_rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows of the best vectors of each distinct query, back on the query rows.

    Ids that own_left_out took are gone already; other queries have one vector of their own id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1)["id"])
    best = scored.where(F.size("ids") > 0).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    gathered = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    named = queries.join(gathered, queries["number"] == gathered["query"]).select(
        "vector", F.col("own").alias("_own"), "found")
    rows = query_rows.select(F.col("vec_id").alias("query_id"), "vector", "own").join(named, "vector").where(
        F.col("own").eqNullSafe(F.col("_own")))
    pairs = (
        rows.select("query_id", F.explode("found").alias("f"))
        .select("query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("v"))
        .where(F.col("v.id") != F.col("query_id"))
    )
    # Ranks of different ids first, so that repeats become rows only where they count.
    by_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "v.id")
    near = pairs.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k)
    repeated = near.select("query_id", "score", F.col("v.id").alias("vec_id"), F.explode(
        F.sequence(F.lit(1), F.least(F.col("v.n"), F.lit(k)))).alias("_n"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return repeated.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
