"""Distinct counts that can be merged: stored sketches instead of stored names.

An option for tables in which exact distinct counts over any choice of years cost too much;
``quick_stats`` stays exact. A sketch has a fixed size, however many names it has seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .measures import play_count

PROFILE = ("profile",)
#: Binary logarithm of a sketch's registers, and the standard error of counts of merged sketches.
LOG_REGISTERS = 12
STANDARD_ERROR = 1.04 / (1 << LOG_REGISTERS) ** 0.5
_NAMES = {"artists": "artistName", "albums": "albumName", "tracks": "trackName"}


def stat_sketches(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Per ``by`` and year: plays, milliseconds and a sketch of artists, albums and tracks."""
    return plays.groupBy(*by, "year").agg(
        play_count(plays).alias("plays"), F.sum("msPlayed").alias("msPlayed"),
        *[F.hll_sketch_agg(column, F.lit(LOG_REGISTERS)).alias(name) for name, column in _NAMES.items()],
    )


def quick_stats_estimated(sketches: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Quick stats from any rows of ``stat_sketches``: of some years, some runs, all profiles.

    Plays, years and hours are exact. Distinct artists, albums and tracks are estimates with a
    standard error of ``STANDARD_ERROR``.
    """
    return sketches.groupBy(*by).agg(
        F.sum("plays").alias("records"), F.count_distinct("year").alias("years"),
        *[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in _NAMES],
        V.hours(F.sum("msPlayed")).alias("totalHours"),
    )
