"""Approximate nearest neighbours with balanced posting lists.

Fit, on a bounded sample: centroids from repeated halving by two means, so that every leaf
holds about the same share; a graph that links each centroid with near ones; and the distance
ratio at which enough true neighbours of the sample are found.
Index, over every row: a vector goes to the list of its nearest centroid, and, if it lies on a
boundary, also to further lists whose centroids are nearly as close and not close to one that
it has. Lists are Spark rows; a long list is cut into parts of bounded size.
Search: a query walks the graph in memory to its nearest centroids, drops lists by the distance
ratio, and meets the vectors of the rest in one task for each list part. Scores are exact.

Inner products become distances by one more component, which lifts every vector to the norm of
the longest; queries are stretched to that norm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .topk import _ranked, distinct_vectors, own_left_out, usable_pairs, with_own

#: Rows that the index is fitted on, at most; centroids, at most; vectors for each centroid.
SAMPLE, CENTROIDS, PER_LIST = 16384, 4096, 96
#: Lists of one vector, at most; how much farther a further centroid may be.
COPIES, BOUNDARY = 4, 1.08
#: Neighbours of a centroid in the graph; width of the walk.
DEGREE, BEAM = 24, 96
#: Share of true neighbours that the fitted ratio finds on the sample.
AIM = 0.97
#: Vectors of one part of a list.
PART = 4096


@dataclass
class Index:
    centroids: np.ndarray
    links: np.ndarray
    norm: float
    ratio: float


def usable(embedding: Column | str) -> Column:
    """The vector, or null if it is null, empty, zero or holds a null or non-finite number."""
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(column.isNotNull() & ~bad & F.exists(column, lambda x: x != 0), column)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    square = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * (left @ right.T)
    return np.sqrt(np.maximum(square, 0))


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))])


def _stretched(q: np.ndarray, norm: float) -> np.ndarray:
    own = np.sqrt((q**2).sum(1))
    return np.column_stack([q * (norm / np.maximum(own, 1e-300))[:, None], np.zeros(len(q))])


def _halved(x: np.ndarray, leaves: int, draw: np.random.Generator) -> list[np.ndarray]:
    """Means of `leaves` parts of equal size, by splitting in proportion along two means."""
    if leaves <= 1 or len(x) < 2:
        return [x.mean(axis=0)]
    a, b = x[draw.choice(len(x), 2, replace=False)]
    left = leaves // 2
    cut = min(max(1, round(len(x) * left / leaves)), len(x) - 1)
    for _ in range(6):
        order = np.argsort(x @ (b - a), kind="stable")
        a, b = x[order[:cut]].mean(axis=0), x[order[cut:]].mean(axis=0)
    return _halved(x[order[:cut]], left, draw) + _halved(x[order[cut:]], leaves - left, draw)


def _graph(centroids: np.ndarray) -> np.ndarray:
    """Near centroids of each, half of them replaced by far ones drawn at random."""
    n = len(centroids)
    degree = min(DEGREE, n - 1)
    if degree <= 0:
        return np.zeros((n, 0), dtype=np.int64)
    near = np.empty((n, degree), dtype=np.int64)
    for at in range(0, n, 512):
        d = _distances(centroids[at:at + 512], centroids)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near[at:at + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    far = np.random.default_rng(5).integers(0, n, (n, max(2, degree // 4)))
    return np.column_stack([near, far])


def walk(index: Index, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances) near each query, nearest first, by best-first steps on the graph.

    All queries take their step at once: the nearest unvisited centroids of each are opened
    until none of its `beam` best is left unopened."""
    n, q = len(index.centroids), len(queries)
    beam = min(beam, n)
    start = np.linspace(0, n - 1, min(n, 32)).astype(np.int64)
    known = np.zeros((q, n), dtype=bool)
    opened = np.zeros((q, n), dtype=bool)
    distance = np.full((q, n), np.inf)
    known[:, start] = True
    distance[:, start] = _distances(queries, index.centroids[start])
    row = np.arange(q)[:, None]
    while True:
        best = np.argpartition(distance, beam - 1, axis=1)[:, :beam]
        waits = ~opened[row, best] & np.isfinite(distance[row, best])
        if not waits.any():
            break
        who, where = np.nonzero(waits)
        at = best[who, where]
        opened[who, at] = True
        new = index.links[at]
        pair = np.unique((who[:, None] * n + new).ravel())
        who, new = pair // n, pair % n
        fresh = ~known[who, new]
        who, new = who[fresh], new[fresh]
        known[who, new] = True
        for part in range(0, len(who), 65536):
            a, b = who[part:part + 65536], new[part:part + 65536]
            distance[a, b] = np.sqrt(np.maximum(((queries[a] - index.centroids[b]) ** 2).sum(1), 0))
    order = np.take_along_axis(best, np.argsort(distance[row, best], axis=1), axis=1)
    return order, distance[row, order]


def assigned(index: Index, x: np.ndarray) -> list[list[int]]:
    """Lists of each lifted vector: the nearest centroid, and further ones on a boundary."""
    d = _distances(x, index.centroids)
    n = min(4 * COPIES, d.shape[1])
    near = np.argpartition(d, n - 1, axis=1)[:, :n]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
    out = []
    for i, row in enumerate(near):
        own = [int(row[0])]
        limit = d[i, row[0]] * BOUNDARY
        for c in row[1:]:
            if len(own) == COPIES or d[i, c] > limit:
                break
            gap = np.sqrt(((index.centroids[own] - index.centroids[c]) ** 2).sum(1)).min()
            if gap > 0.3 * d[i, c]:
                own.append(int(c))
        out.append(own)
    return out


def _chosen(near: np.ndarray, distance: np.ndarray, ratio: float) -> np.ndarray:
    return distance <= distance[:, :1] * ratio + 1e-12


def fit(sample: np.ndarray, norm: float, rows: int, k: int) -> Index:
    """The index of a sample of vectors that stand for `rows` rows."""
    draw = np.random.default_rng(11)
    lists = int(min(CENTROIDS, max(1, rows // PER_LIST), max(1, len(sample) // 4)))
    lifted = _lifted(sample, norm)
    centroids = np.array(_halved(lifted, lists, draw))
    index = Index(centroids, _graph(centroids), norm, 1.0)
    asked = draw.choice(len(sample), min(256, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    top = min(max(1, k * len(sample) // max(rows, 1) + 4), max(1, len(sample) - 1))
    true = np.argpartition(-scores, top - 1, axis=1)[:, :top]
    near, distance = walk(index, _stretched(sample[asked], norm))
    place = np.full((len(asked), lists), np.inf)
    np.put_along_axis(place, near, distance / np.maximum(distance[:, :1], 1e-12), axis=1)
    own = assigned(index, lifted[np.unique(true)])
    of = {int(v): own[i] for i, v in enumerate(np.unique(true))}
    needed = np.sort([min(place[i, c] for c in of[int(v)]) for i, row in enumerate(true) for v in row])
    ratio = needed[min(len(needed) - 1, int(AIM * len(needed)))]
    index.ratio = float(ratio) if np.isfinite(ratio) else float(np.max(place[np.isfinite(place)]))
    return index


def _dense(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _list_search(key: tuple, queries: pd.DataFrame, posts: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(posts):
        q, x = _dense(queries["vector"]), _dense(posts["vector"])
        number = posts["number"].to_numpy()
        top = min(k, len(x))
        for at in range(0, len(q), 512):
            scores = q[at:at + 512] @ x.T
            usable = usable_pairs(queries.iloc[at:at + 512], posts)
            if usable is not None:
                scores[~usable] = -np.inf
            best = np.argpartition(-scores, top - 1, axis=1)[:, :top]
            for i, found in enumerate(best):
                found = found if usable is None else found[usable[i, found]]
                # Summed in one fixed order, so that a vector's score is the same in any list.
                exact = (x[found] * q[at + i]).sum(axis=1)
                out.append((queries["number"].iat[at + i], number[found], exact))
    return pd.DataFrame(out, columns=["query", "numbers", "scores"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows found of every query row, by largest inner product.

    `vectors` has vec_id and embedding. Rows with a null vec_id, and vectors that are null,
    empty, zero or hold a null or non-finite number, take no part; vectors meet those of equal
    length only, and every length has an index of its own. Returns query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id. Fewer other rows than k give fewer ranks.
    Rows of a query's own vec_id are never its neighbours. Further columns are ignored. An
    index is fitted on at most `sample` distinct vectors and holds all of them.
    """
    spark = vectors.sparkSession
    valid = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), usable("embedding").alias("vector"),
        is_query.alias("_asked")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    # One row for each length, of which a table of embeddings has few.
    lengths = sorted(r[0] for r in valid.select(F.size("vector")).distinct().collect())
    if not lengths:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    found = [_nearest_of_length(valid.where(F.size("vector") == n), k, sample) for n in lengths]
    if len(found) == 1:
        return found[0]
    # An id with vectors of several lengths has neighbours of each.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k)


def _nearest_of_length(valid: DataFrame, k: int, sample: int) -> DataFrame:
    """`nearest` for vectors of one length; `valid` has vec_id, vector and _asked."""
    candidates = stored(distinct_vectors(valid.drop("_asked"), k + 1))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows, most = candidates.agg(F.count("*"), F.max(squares)).first()
    picked = candidates.orderBy(F.xxhash64("vector"), "number").limit(sample).select("vector").collect()
    index = fit(np.array([r[0] for r in picked], dtype=np.float64), float(np.sqrt(most)), rows, k)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at:at + 2048]
                part = part.assign(sole=part["sole"].astype("Int64"), list=assigned(index, _lifted(_dense(part["vector"]), index.norm)))
                yield part.explode("list").astype({"list": "int32"})[["list", "number", "vector", "sole"]]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                near, distance = walk(index, _stretched(_dense(part["vector"]), index.norm))
                keep = _chosen(near, distance, index.ratio)
                part = part.assign(own=part["own"].astype("Int64"), list=[row[use] for row, use in zip(near, keep)])
                yield part.explode("list").astype({"list": "int32"})[["list", "number", "vector", "own"]]

    kind = next(f.dataType.simpleString() for f in candidates.schema if f.name == "vector")
    form = f"list INT, number BIGINT, vector {kind}"
    posts = stored(candidates.select("number", "vector", "sole").mapInPandas(
        post, form + ", sole BIGINT"))
    sizes = posts.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    query_rows = stored(with_own(valid.where("_asked").select("vec_id", "vector").distinct(), valid))
    queries = stored(query_rows.select("vector", "own").distinct().withColumn(
        "number", F.monotonically_increasing_id()))
    # The number of lists is bounded by CENTROIDS, and so is this broadcast.
    parts = F.broadcast(sizes)
    held = posts.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("number"), F.col("parts")).cast("int")).drop("parts")
    asked = queries.mapInPandas(ask, form + ", own BIGINT").join(parts, "list").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = asked.groupBy("list", "part").cogroup(held.groupBy("list", "part")).applyInPandas(
        lambda key, a, b: _list_search(key, a, b, k + 1),
        "query BIGINT, numbers ARRAY<BIGINT>, scores ARRAY<DOUBLE>")
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    scored = (
        found.select("query", F.explode(F.arrays_zip("numbers", "scores")).alias("e"))
        .groupBy("query", F.col("e.numbers").alias("number")).agg(F.max("e.scores").alias("score"))
        # Only what can be among the nearest meets its ids; ties stay.
        .withColumn("_r", F.rank().over(best)).where(F.col("_r") <= k + 1)
        .join(candidates.select("number", "ids"), "number")
        .join(queries.select(F.col("number").alias("query"), "own"), "query")
        .select("query", "score", own_left_out("ids", "own").alias("ids"))
    )
    return _ranked(scored, query_rows, queries, k)
