"""Embedding whitening with eigenvectors refined in mixed precision.

Sums of every dimension and the covariance are distributed: a task adds up the products of its
own centred vectors in blocks, and the partial matrices are added row by row. The covariance
(one matrix of the vectors' length) is solved in float32; Ogita-Aishima iterations then correct
all eigenvectors at once by matrix products in extended precision. Eigenvalues nearer to each
other than the present error can't be told apart by an iteration: each such cluster is solved
by itself in the space of its own vectors and goes on from there.

Vectors are lists of whole numbers, so sums, differences from the mean and deviations are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that are centred and multiplied at a time.
BLOCK = 4096
#: Iterations at most; the error is squared in each, so a handful is enough.
ITERATIONS = 30
#: Corrections below this end the iterations.
SMALL = np.longdouble(2) ** -58
#: A variance below this share of the largest one is rounding: its direction has none.
NO_VARIANCE = 1e-14
#: Entries beyond this don't stand in a double without gaps.
LARGEST = 2 ** 52


def fixed_point(vector: Column | str, scale: int, shift: int) -> Column:
    """floor(scale * entry) + shift of every entry; null for a vector that is null or holds null,
    non-finite entries or entries too large for whole numbers in a double."""
    col = F.col(vector) if isinstance(vector, str) else vector
    scaled = F.transform(col, lambda c: F.lit(float(scale)) * c.cast("double"))
    usable = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < float(LARGEST), F.lit(False)))
    return F.when(usable, F.transform(scaled, lambda c: F.floor(c) + F.lit(shift)))


# -- the eigenvectors --------------------------------------------------------------------

def _clusters(values: np.ndarray, width: np.longdouble) -> list[np.ndarray]:
    """Places of values that form a chain of gaps below `width`, where more than one do."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.longdouble]:
    """One iteration: better eigenvectors of `a` from `x`, their values, the largest correction."""
    eye = np.eye(len(a), dtype=np.longdouble)
    r = eye - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    width = 2 * (np.sqrt((off ** 2).sum()) + np.sqrt((a ** 2).sum()) * np.sqrt((r ** 2).sum()))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > width
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
    x = x + x @ e
    for own in _clusters(values, width):
        # Within a cluster e only made the vectors orthogonal; their directions come from a solve
        # of the cluster alone, moved to its middle and scaled so that its gaps are seen.
        part = x[:, own]
        inner = part.T @ (a @ part - values[own].mean() * part)
        size = np.abs(inner).max()
        if size > 0:
            turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))[1]
            x[:, own] = part @ turn.astype(np.longdouble)
    return values, x, np.abs(e).max()


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, in double."""
    largest = np.abs(covariance).max(initial=0)
    if not largest > 0:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    power = int(np.frexp(largest)[1])
    a = np.ldexp(covariance.astype(np.longdouble), -power)
    a = (a + a.T) / 2
    for start in (np.float32, np.float64):
        x = np.linalg.eigh(a.astype(start))[1].astype(np.longdouble)
        for _ in range(ITERATIONS):
            values, x, change = refine(a, x)
            if not change >= SMALL:
                break
        if change < SMALL:
            break
    # Solves of clusters are in double: orthogonal again, then the values of what is returned.
    x = x + x @ (np.eye(len(a), dtype=np.longdouble) - x.T @ x) / 2
    x = x / np.sqrt((x ** 2).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return np.ldexp(values[order], power).astype(np.float64), x[:, order].astype(np.float64)


# -- the tasks ---------------------------------------------------------------------------

def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the rows, matrix of whole numbers) of the vectors of each length."""
    column = batch["x"]
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    widths = np.diff(offsets)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), BLOCK):
            some = rows[at:at + BLOCK]
            yield width, some, flat[offsets[some][:, None] + np.arange(width)]


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as long where it fits, else as Python's whole numbers."""
    largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    kind = np.int64 if largest < 2 ** 63 else object
    return n * x.astype(kind) - np.array(sums, dtype=kind)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _differences(x, n, sums).astype(np.float64) / n


def _squares(differences: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; None above the range of a long."""
    largest = max(abs(int(differences.max())), abs(int(differences.min())))
    if differences.shape[1] * largest * largest < 2 ** 63:
        return (differences.astype(np.int64) ** 2).sum(axis=1).tolist()
    found = (differences.astype(object) ** 2).sum(axis=1)
    return [s if s < 2 ** 63 else None for s in found]


_PARTIAL = "width INT, i INT, partial ARRAY<DOUBLE>"
_PARTIAL_ARROW = pa.schema([("width", pa.int32()), ("i", pa.int32()), ("partial", pa.list_(pa.float64()))])


def _rows_of(width: int, matrix: np.ndarray) -> pa.RecordBatch:
    k = matrix.shape[1]
    return pa.record_batch([
        pa.array(np.full(len(matrix), width, np.int32)), pa.array(np.arange(len(matrix), dtype=np.int32)),
        pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * k), pa.array(matrix.ravel())),
    ], schema=_PARTIAL_ARROW)


def _products(vectors: DataFrame, moments: dict[int, tuple[int, list[int]]],
              project: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Per length, the sum over all vectors of the products of their centred (and projected)
    entries. Each row of the matrices is added up in one task, as partial rows come in."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _by_width(batch):
                d = _centred(x, *moments[width])
                if project is not None:
                    d = d @ project[width]
                if width in sums:
                    sums[width] += d.T @ d
                else:
                    sums[width] = d.T @ d
        for width, matrix in sums.items():
            yield _rows_of(width, matrix)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            partial = batch["partial"]
            for at, key in enumerate(zip(batch["width"].to_pylist(), batch["i"].to_pylist())):
                own = partial[at].values.to_numpy()
                sums[key] = sums[key] + own if key in sums else own.copy()
        if sums:
            yield pa.RecordBatch.from_pylist(
                [{"width": w, "i": i, "partial": v.tolist()} for (w, i), v in sums.items()], schema=_PARTIAL_ARROW)

    added = vectors.select("x").mapInArrow(multiply, _PARTIAL).repartition("width", "i").mapInArrow(add, _PARTIAL)
    rows = defaultdict(dict)
    for row in added.collect():  # matrices of vector lengths, whatever the number of vectors
        rows[row.width][row.i] = row.partial
    return {width: np.array([own[i] for i in range(len(own))]) for width, own in rows.items()}


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """Whitened components of all vectors: one row per vector and component.

    `vectors`: vec_id and x, a list of whole numbers (see `fixed_point`). Returns vec_id,
    component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    Null vectors take no part; empty ones have no components; an empty table gives no rows.
    Repeated rows and null or repeated ids are vectors of their own. Vectors of different
    lengths share no covariance: each length is whitened by itself, and n is the number of
    vectors of that length. Where vectors have fewer than `components` directions with variance
    (short vectors, few rows, ties in all entries), whitened is null for the others and
    identity_error leaves them out. A deviation above the range of a long is null. Further
    columns are ignored. Driver and tasks hold one matrix for each length, none of the vectors.
    """
    spark = vectors.sparkSession
    # Names of its own for what it works with, whatever columns there are.
    rows = vectors.where("x IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), "x")
    entries = rows.select(F.size("x").alias("width"), F.posexplode("x").alias("i", "entry"))
    totals: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    summed = entries.groupBy("width", "i").agg(
        F.count("*").alias("n"), F.sum(F.col("entry").cast("decimal(20,0)")).alias("total"))
    for row in summed.collect():  # as many rows as the lengths have dimensions
        totals[row.width][row.i] = row.n, int(row.total)
    moments = {w: (own[0][0], [own[i][1] for i in range(w)]) for w, own in totals.items()}

    project, explained = {}, {}
    for width, products in _products(rows, moments).items() if moments else ():
        values, x = eigenvectors(products / moments[width][0])
        trace = np.trace(products) / moments[width][0]
        k = min(components, width)
        full = int((values[:k] > NO_VARIANCE * max(values[0], 0)).sum()) if values[0] > 0 else 0
        project[width] = x[:, :full] / np.sqrt(values[:full])
        explained[width] = np.maximum(values[:k], 0) / trace if trace > 0 else np.zeros(k)
    errors = {w: 0.0 for w in moments}
    for width, products in _products(rows, moments, project).items() if moments else ():
        errors[width] = float(np.abs(products / moments[width][0] - np.eye(len(products))).max(initial=0))

    model = spark.sparkContext.broadcast({
        w: (*moments[w], project[w], explained[w], errors[w]) for w in moments})

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, places, x in _by_width(batch):
                n, sums, own, share, error = model.value[width]
                differences = _differences(x, n, sums)
                k, full, m = len(share), own.shape[1], len(places)
                found = np.full((m, k), np.nan)
                found[:, :full] = (differences.astype(np.float64) / n) @ own
                none = np.tile(np.arange(k) >= full, m)
                deviations = pa.array(_squares(differences), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch([
                    batch["vec_id"].take(pa.array(places)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), deviations.take(each),
                    pa.array(found.ravel(), mask=none), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(
        out, "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, "
             "identity_error DOUBLE")
