"""Reports over playlists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import values as V
from .measures import with_hours
from .topk import top_k

PROFILE = ("profile",)
_SONG = ("trackName", "artistName")


def songs_in_most_playlists(
    items: DataFrame, k: int = C.TOP_SHARED_SONGS, by: Sequence[str] = PROFILE
) -> DataFrame:
    """Songs found in more than one playlist (by name), most playlists first.

    A song's playlists are counted and never gathered: the sample of names, of the
    top songs only, comes from a window cut to three rows per song before its
    shuffle, so a song in millions of playlists costs each task three rows.
    """
    song = [*by, *_SONG]
    pairs = items.select(*song, "playlistName").distinct()
    counts = pairs.groupBy(*song).agg(F.count(F.lit(1)).alias("playlistCount"))
    top = top_k(counts.where(F.col("playlistCount") > 1), k, "playlistCount", _SONG, by)
    first = Window.partitionBy(*song).orderBy("playlistName")
    samples = (
        pairs.join(top.select(*song), song, "left_semi")
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= C.NAMES_SAMPLED)
        .groupBy(*song)
        .agg(F.collect_list("playlistName").alias("_names"))
    )
    return top.join(samples, song).select(
        *song, V.track_label().alias("song"), "playlistCount",
        V.name_sample("_names", "playlistCount").alias("playlists"),
    )


def top_playlists(
    playlists: DataFrame, k: int = C.TOP_PLAYLISTS, by: Sequence[str] = PROFILE
) -> DataFrame:
    """Playlists by estimated minutes."""
    return with_hours(top_k(playlists, k, "totalMinutes", ["playlistName"], by)).select(
        *by, "playlistName", "totalMinutes", "trackCount", "totalHours"
    )


def top_playlists_display(top: DataFrame) -> DataFrame:
    """Rounded and renamed as shown: whole minutes, hours to one place."""
    rounded = top.withColumns({
        "totalMinutes": V.whole("totalMinutes"), "totalHours": V.half_even("totalHours"),
    })
    # Column titles of the table shown.
    return rounded.withColumnsRenamed({
        "playlistName": "Playlist Name", "totalMinutes": "Total Minutes",
        "trackCount": "Track Count", "totalHours": "Total Hours",
    })
