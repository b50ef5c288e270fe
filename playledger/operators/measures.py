"""Measures that read the same from plays and from a rollup of plays.

Reports sum ``msPlayed`` and divide once at the end: whole milliseconds add up
exactly, so results do not depend on how rows were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def total_minutes(name: str = "totalMinutes") -> Column:
    return V.minutes(F.sum("msPlayed")).alias(name)


def play_count(df: DataFrame) -> Column:
    """Number of plays: summed where ``df`` is a rollup, else counted."""
    return F.sum("plays") if "plays" in df.columns else F.count(F.lit(1))


def with_hours(df: DataFrame) -> DataFrame:
    return df.withColumn("totalHours", V.hours_from_minutes("totalMinutes"))
