"""Filter options: distinct values of four columns, and searching them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .topk import top_k

PROFILE = ("profile",)
FACETS = {
    "year": "year", "artist": "artistName", "album": "albumName", "song": "trackName",
}


def facets(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Every distinct non-NULL value per facet: ``facet, value``."""
    pairs = [
        F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value"))
        for name, column in FACETS.items()
    ]
    return (
        plays.select(*by, F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .distinct()
    )


def facet_counts(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Facet values with the number of plays that have them: ``facet, value, n``."""
    pairs = [
        F.struct(F.lit(name).alias("facet"), F.col(column).cast("string").alias("value"))
        for name, column in FACETS.items()
    ]
    weight = [F.col("plays")] if "plays" in plays.columns else [F.lit(1).cast("bigint").alias("plays")]
    return (
        plays.select(*by, *weight, F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .groupBy(*by, "facet", "value").agg(F.sum("plays").alias("n"))
    )


def changed_facet_counts(
    counts: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None,
    by: Sequence[str] = PROFILE,
) -> DataFrame:
    """Counts after plays were added and removed; a value that no play has any more goes.

    Only the changed plays are read. ``added`` and ``removed`` are plays or rollups, and
    ``removed`` holds rows that were counted before.
    """
    every = counts.select(*by, "facet", "value", "n")
    if added is not None:
        every = every.unionByName(facet_counts(added, by))
    if removed is not None:
        every = every.unionByName(facet_counts(removed, by).withColumn("n", -F.col("n")))
    return every.groupBy(*by, "facet", "value").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def _matches(term: str):
    return F.contains(F.lower(F.trim("value")), F.lower(F.trim(F.lit(term))))


def search_options(
    options: DataFrame, facet: str, term: str = "", by: Sequence[str] = PROFILE
) -> DataFrame:
    """Values that contain the term; without a term the first hundred."""
    chosen = options.where(F.col("facet") == facet)
    if term:
        return chosen.where(_matches(term)).select(*by, "value")
    preview = chosen.select(*by, "value").withColumn("_same", F.lit(0))
    return top_k(preview, C.OPTION_PREVIEW, "_same", ["value"], by).drop("_same")


def suggest_options(
    options: DataFrame, facet: str, term: str, by: Sequence[str] = PROFILE
) -> DataFrame:
    """Where nothing contains the term, the first values sharing a character with it."""
    chosen = options.where(F.col("facet") == facet)
    letters = F.split(F.lower(F.lit(term)), "")
    alike = chosen.where(F.arrays_overlap(F.split(F.lower("value"), ""), letters))
    first = top_k(
        alike.select(*by, "value").withColumn("_same", F.lit(0)),
        C.SUGGESTIONS, "_same", ["value"], by,
    ).drop("_same")
    found = chosen.where(_matches(term))
    if not by:
        # One row at most says whether anything matches.
        any_found = F.broadcast(found.select(F.lit(1).alias("_found")).limit(1))
        return first.join(any_found, F.lit(True), "left_anti")
    return first.join(found.select(*by).distinct(), list(by), "left_anti")


def selection_frame(options: DataFrame, selection: Mapping[str, Sequence]) -> DataFrame:
    """A selection as rows ``facet, value``; broadcast where its length allows."""
    rows = sorted({(f, str(v)) for f, values in selection.items() for v in values})
    frame = options.sparkSession.createDataFrame(rows, "facet STRING, value STRING")
    return F.broadcast(frame) if len(rows) <= C.BROADCAST_ROWS else frame


def prune_selection(
    options: DataFrame, selection: DataFrame, by: Sequence[str] = PROFILE
) -> DataFrame:
    """The selected values that still exist, per profile.

    ``selection`` has ``facet, value`` and may have the ``by`` columns. Options are
    distinct, so the join keeps each pair once.
    """
    keys = [c for c in (*by, "facet", "value") if c in selection.columns]
    return options.join(selection.select(*keys), keys, "left_semi").select(*by, "facet", "value")
