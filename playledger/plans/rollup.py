"""One aggregate that most reports can read instead of the plays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.measures import play_count

_KEYS = ("year", "year_month", "artistName", "albumName", "trackName")


def play_rollup(plays: DataFrame, by: Sequence[str] = ("profile",)) -> DataFrame:
    """Milliseconds and plays per year, month, artist, album and track.

    It keeps the column names of the plays, so the facet, count, leader and trend
    reports take either. Write it once and run a whole dashboard from it.
    """
    return plays.groupBy(*by, *_KEYS).agg(
        F.sum("msPlayed").alias("msPlayed"), play_count(plays).alias("plays")
    )
