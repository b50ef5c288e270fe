"""The four facet filters and their fall-back to the whole table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .facets import FACETS, PROFILE


@dataclass(frozen=True)
class Selection:
    """Chosen values per facet; an empty facet does not filter.

    Selecting every value of a facet keeps every row, as not filtering does.
    """

    years: Sequence[int] = field(default_factory=tuple)
    artists: Sequence[str] = field(default_factory=tuple)
    albums: Sequence[str] = field(default_factory=tuple)
    songs: Sequence[str] = field(default_factory=tuple)

    def chosen(self) -> dict[str, Sequence]:
        values = (self.years, self.artists, self.albums, self.songs)
        return {c: v for c, v in zip(FACETS.values(), values) if v}


def select_rows(plays: DataFrame, selection: Selection) -> DataFrame:
    """Rows that pass every chosen facet; may be empty.

    Short lists become predicates that reach the Parquet scan. A longer list is a
    table to semi-join with; its length is known here, so it is broadcast only
    while it is small and otherwise joined by shuffle, where AQE splits hot keys.
    """
    for column, values in selection.chosen().items():
        if len(values) <= C.INLINE_VALUES:
            plays = plays.where(F.col(column).isin(list(values)))
        else:
            kind = plays.schema[column].dataType
            rows = [(v,) for v in dict.fromkeys(values)]
            listed = plays.sparkSession.createDataFrame(rows, f"{column} {kind.simpleString()}")
            if len(rows) <= C.BROADCAST_ROWS:
                listed = F.broadcast(listed)
            plays = plays.join(listed, column, "left_semi")
    return plays


def apply_filters(
    plays: DataFrame,
    selection: Selection,
    profiles: DataFrame | None = None,
    by: Sequence[str] = PROFILE,
) -> DataFrame:
    """Selected rows; a profile with none keeps all its rows instead.

    Everything is one plan and no job runs while it is built. A profile without a hit shows in
    one grouped pass over the filtered columns; the rows of such profiles are joined in again,
    where the runtime re-plans: without such profiles that side is empty, few are broadcast, and
    a hot one is split.

    ``profiles`` may name the profiles to look at (one row each); else they are
    taken from the plays.
    """
    if not selection.chosen():
        return plays
    hits = select_rows(plays, selection)
    if not by:
        # One row at most says whether anything was found.
        found = F.broadcast(hits.select(F.lit(1).alias("_found")).limit(1))
        return hits.unionByName(plays.join(found, F.lit(True), "left_anti"))
    keys = list(by)
    everyone = (plays if profiles is None else profiles).select(*keys).distinct()
    missed = everyone.join(hits.select(*keys).distinct(), keys, "left_anti")
    return hits.unionByName(plays.join(missed, keys, "left_semi"))
