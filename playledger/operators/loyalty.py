"""How steadily a listener returns to an artist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import values as V
from .measures import play_count, total_minutes
from .topk import top_k

PROFILE = ("profile",)


def artist_days(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Milliseconds and plays per artist and day: a rollup ``artist_loyalty`` reads."""
    return (
        plays.where(V.known("artistName"))
        .groupBy(*by, "artistName", V.date_key("ts").alias("ts"))
        .agg(F.sum("msPlayed").alias("msPlayed"), play_count(plays).alias("plays"))
    )


def artist_loyalty(
    plays: DataFrame,
    min_minutes: float = C.MIN_LOYAL_MINUTES,
    k: int = C.TOP_LOYALTY,
    by: Sequence[str] = PROFILE,
) -> DataFrame:
    """First and last day, distinct days, span and score of the most-played artists.

    Without a ``ts`` column days are estimated from plays over a one-year span.
    An empty date is no day; a first or last text that is no date leaves the
    artist's span and score NULL.
    """
    named = plays.where(V.known("artistName"))
    if "ts" in plays.columns:
        date = F.col("_date")
        # One row per artist and day first: that much is summed by hash in every task, and the
        # first and last text of an artist are sought in few rows.
        days = named.groupBy(
            *by, "artistName", F.nullif(V.date_key("ts"), F.lit("")).alias("_date")
        ).agg(F.sum("msPlayed").alias("msPlayed"))
        artists = (
            days.groupBy(*by, "artistName")
            .agg(
                F.min(date).alias("first_listen"),
                F.max(date).alias("last_listen"),
                total_minutes(),
                F.count(date).alias("unique_days"),
            )
            .withColumn("span_days", V.span_days("first_listen", "last_listen"))
        )
    else:
        artists = (
            named.groupBy(*by, "artistName")
            .agg(total_minutes(), play_count(plays).alias("play_count"))
            .withColumn("unique_days", F.col("play_count") * C.DAYS_PER_PLAY)
            .withColumn("span_days", F.lit(C.SPAN_WITHOUT_DATES))
        )
    return top_loyal(artists, min_minutes, k, by)


def top_loyal(artists: DataFrame, min_minutes: float, k: int, by: Sequence[str]) -> DataFrame:
    """The most-played artists with their scores, from days and spans of each."""
    top = top_k(
        artists.where(F.col("totalMinutes") >= min_minutes), k, "totalMinutes", ["artistName"], by
    )
    return top.withColumn("loyalty_score", V.loyalty_score("unique_days", "span_days"))


def most_loyal(
    loyalty: DataFrame, k: int = C.TOP_MOST_LOYAL, by: Sequence[str] = PROFILE
) -> DataFrame:
    """The best scores among the rows of :func:`artist_loyalty`, minutes whole."""
    ordered = loyalty.withColumn("_less", -F.col("totalMinutes"))
    return top_k(ordered, k, "loyalty_score", ["_less", "artistName"], by).select(
        *by, "artistName", V.whole("totalMinutes").alias("totalMinutes"),
        "loyalty_score", "span_days", "unique_days",
    )
