"""Counts and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .measures import play_count

PROFILE = ("profile",)


def record_counts(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Total and filtered counts; both are of the rows given."""
    return plays.groupBy(*by).agg(
        play_count(plays).alias("totalRecords"), play_count(plays).alias("filteredRecords")
    )


def quick_stats(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Records, distinct years, artists, albums and tracks, and hours."""
    return plays.groupBy(*by).agg(
        play_count(plays).alias("records"),
        F.count_distinct("year").alias("years"),
        F.count_distinct("artistName").alias("artists"),
        F.count_distinct("albumName").alias("albums"),
        F.count_distinct("trackName").alias("tracks"),
        V.hours(F.sum("msPlayed")).alias("totalHours"),
    )


def quick_stats_display(stats: DataFrame) -> DataFrame:
    """Quick stats as shown: hours to one place."""
    return stats.withColumn("totalHours", V.half_even("totalHours"))


def available_years(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    years = plays.where(F.col("year").isNotNull()).select(*by, "year").distinct()
    return years.orderBy(*by, "year")


def year_span(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Years from the first to the last, both included."""
    return plays.groupBy(*by).agg(
        (F.max("year") - F.min("year") + 1).cast("int").alias("years_span")
    )
