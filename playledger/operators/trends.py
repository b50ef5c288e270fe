"""Listening over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import values as V
from .measures import total_minutes, with_hours

PROFILE = ("profile",)


def _month(plays: DataFrame, parsed: bool) -> Column:
    """Month of a play: the stored key, else cut or parsed from its time column."""
    if not parsed and "year_month" in plays.columns:
        return F.col("year_month")
    time = V.first_timestamp(plays)
    if time is None:
        return F.lit(None).cast("string")
    return V.month_key_parsed(time) if parsed else V.month_key(time)


def monthly_trend(
    plays: DataFrame, parsed: bool = False, by: Sequence[str] = PROFILE
) -> DataFrame:
    """Minutes per month; ``parsed`` reads the time strictly instead of cutting it.

    An empty time text is a month of its own when cut, and no month when parsed.
    """
    months = (
        plays.where(F.col("year") > C.MIN_YEAR)
        .select(*by, _month(plays, parsed).alias("year_month"), "msPlayed")
        .where(F.col("year_month").isNotNull())
    )
    totals = months.groupBy(*by, "year_month").agg(total_minutes())
    return with_hours(totals).orderBy(*by, "year_month")


def yearly_trend(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Minutes per year."""
    totals = (
        plays.where(F.col("year") > C.MIN_YEAR).groupBy(*by, "year").agg(total_minutes())
    )
    return with_hours(totals).orderBy(*by, "year")


def trend(plays: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """Months for a profile with more than five of them, else years.

    One scan and one shuffle of the plays give sums per year and month; months,
    years and the choice between them all come from those few rows. Cutting the
    text always gives at least as many months as parsing it, so parsing cannot
    reach the limit where cutting has not.
    """
    base = (
        plays.where(F.col("year") > C.MIN_YEAR)
        .select(*by, "year", _month(plays, False).alias("year_month"), "msPlayed")
        .groupBy(*by, "year", "year_month")
        .agg(F.sum("msPlayed").alias("msPlayed"))
    )
    periods = [
        F.struct(F.lit(grain).alias("grain"), F.col(key).cast("string").alias("period"))
        for grain, key in (("month", "year_month"), ("year", "year"))
    ]
    grains = base.select(*by, "msPlayed", F.inline(F.array(*periods))).where(
        F.col("period").isNotNull()
    )
    totals = grains.groupBy(*by, "grain", "period").agg(total_minutes())
    # One row per period of a profile reaches this window: years and months.
    months = F.count(F.when(F.col("grain") == "month", 1)).over(Window.partitionBy(*by))
    chosen = F.when(months > C.MONTHS_FOR_TREND, "month").otherwise("year")
    return (
        with_hours(totals.withColumn("_chosen", chosen).where(F.col("grain") == F.col("_chosen")))
        .drop("_chosen")
        .orderBy(*by, "period")
    )
