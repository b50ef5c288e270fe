"""Most-played artists, albums and tracks, overall and per year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import values as V
from .measures import total_minutes, with_hours
from .topk import top_k

PROFILE = ("profile",)
ARTIST = ("artistName",)
ALBUM = ("albumName",)
TRACK = ("trackName", "artistName")


def _ranked(
    plays: DataFrame, names: Sequence[str], k: int, by: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """Top ``k`` of the names by minutes in each ``by`` and ``extra`` group."""
    totals = (
        plays.where(V.known(*names)).groupBy(*by, *extra, *names).agg(total_minutes())
    )
    top = with_hours(top_k(totals, k, "totalMinutes", names, by=(*by, *extra)))
    return top.withColumn("trackLabel", V.track_label()) if tuple(names) == TRACK else top


def top_artists(plays: DataFrame, k: int = C.TOP_ARTISTS, by: Sequence[str] = PROFILE) -> DataFrame:
    return _ranked(plays, ARTIST, k, by)


def top_albums(plays: DataFrame, k: int = C.TOP_ALBUMS, by: Sequence[str] = PROFILE) -> DataFrame:
    """By album name alone: albums of one name count together."""
    return _ranked(plays, ALBUM, k, by)


def top_tracks(plays: DataFrame, k: int = C.TOP_TRACKS, by: Sequence[str] = PROFILE) -> DataFrame:
    return _ranked(plays, TRACK, k, by)


def favourite_songs(plays: DataFrame, k: int = C.FAVOURITES, by: Sequence[str] = PROFILE) -> DataFrame:
    """By track name alone, whoever plays it."""
    return _ranked(plays, ("trackName",), k, by)


def _by_year(
    plays: DataFrame, names: Sequence[str], k: int, year: int | str | None, by: Sequence[str]
) -> DataFrame:
    dated = plays.where(F.col("year") > C.MIN_YEAR)
    if isinstance(year, int):
        return _ranked(dated.where(F.col("year") == year), names, k, by, ("year",))
    top = _ranked(dated, names, k, by, ("year",))
    if year is None:
        return top
    if year != "latest":
        raise ValueError("year is a number, 'latest' or None")
    # The cut rows and the last years are both small: no play is shuffled for this.
    latest = plays.groupBy(*by).agg(F.max("year").alias("year"))
    return top.join(latest, [*by, "year"], "left_semi")


def top_artists_by_year(
    plays: DataFrame, k: int = C.TOP_PER_YEAR, year: int | str | None = None,
    by: Sequence[str] = PROFILE,
) -> DataFrame:
    """Top artists of every year, of one ``year`` or of each profile's ``"latest"``."""
    return _by_year(plays, ARTIST, k, year, by)


def top_albums_by_year(
    plays: DataFrame, k: int = C.TOP_PER_YEAR, year: int | str | None = None,
    by: Sequence[str] = PROFILE,
) -> DataFrame:
    return _by_year(plays, ALBUM, k, year, by)


def top_tracks_by_year(
    plays: DataFrame, k: int = C.TOP_PER_YEAR, year: int | str | None = None,
    by: Sequence[str] = PROFILE,
) -> DataFrame:
    return _by_year(plays, TRACK, k, year, by)
