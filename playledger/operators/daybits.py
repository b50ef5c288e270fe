"""Distinct days kept as bits: loyalty that adds up over runs without the plays.

A year of an artist is six whole numbers of 64 bits, one bit for each day. Bits of several runs
or of stored and landed rows are joined by OR, so a day counts once wherever it came from. Whole
numbers are aggregated in place by hash; a bitmap function's binary would take 4 KB for any year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import values as V
from .loyalty import top_loyal
from .measures import play_count, total_minutes

PROFILE = ("profile",)
_DAY = "yyyy-MM-dd"
#: 366 days in words of 64 bits.
_WORDS = tuple(f"days{i}" for i in range(6))


def artist_day_bits(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """One row per artist and year: ``days0`` to ``days5``, first and last day, sums.

    A text that is no date of the form ``yyyy-MM-dd`` is a day of its own that no calendar has:
    it gets a row with that text in ``other_day``. Rows without a date, or with an empty one,
    have neither year nor text and no bits. Takes plays or ``artist_days``.
    """
    text = F.nullif(V.date_key("ts"), F.lit(""))
    day = F.try_to_date(text, _DAY)
    dated = plays.where(V.known("artistName")).select(
        *by, "artistName", "msPlayed", *[c for c in ("plays",) if c in plays.columns],
        F.when(F.date_format(day, _DAY) == text, day).alias("_day"), text.alias("_text"))
    place = F.dayofyear("_day") - 1
    bits = [
        F.coalesce(
            F.bit_or(F.when(F.floor(place / 64) == i, F.expr("shiftleft(1L, (dayofyear(_day) - 1) % 64)"))),
            F.lit(0).cast("bigint")).alias(word)
        for i, word in enumerate(_WORDS)
    ]
    return dated.groupBy(
        *by, "artistName", F.year("_day").alias("year"),
        F.when(F.col("_day").isNull(), F.col("_text")).alias("other_day"),
    ).agg(
        *bits, F.min(F.unix_date("_day")).alias("first_day"), F.max(F.unix_date("_day")).alias("last_day"),
        F.sum("msPlayed").alias("msPlayed"), play_count(plays).alias("plays"),
    )


def merge_day_bits(bits: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Rows of several runs, or of several profiles for fewer ``by``, as one row per key."""
    return bits.groupBy(*by, "artistName", "year", "other_day").agg(
        *[F.bit_or(word).alias(word) for word in _WORDS],
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        F.sum("msPlayed").alias("msPlayed"), F.sum("plays").alias("plays"),
    )


def loyalty_from_bits(
    bits: DataFrame,
    min_minutes: float = C.MIN_LOYAL_MINUTES,
    k: int = C.TOP_LOYALTY,
    by: Sequence[str] = PROFILE,
) -> DataFrame:
    """The rows of ``artist_loyalty``, from day bits of any number of runs."""
    counted = sum((F.bit_count(word) for word in _WORDS[1:]), F.bit_count(_WORDS[0]))
    days = counted + F.col("other_day").isNotNull().cast("int")

    def shown(day: str):
        return F.coalesce("other_day", F.date_format(F.date_from_unix_date(day), _DAY))

    artists = merge_day_bits(bits, by).groupBy(*by, "artistName").agg(
        F.min(shown("first_day")).alias("first_listen"),
        F.max(shown("last_day")).alias("last_listen"),
        total_minutes(),
        F.sum(days).cast("bigint").alias("unique_days"),
    ).withColumn("span_days", V.span_days("first_listen", "last_listen"))
    return top_loyal(artists, min_minutes, k, by)
