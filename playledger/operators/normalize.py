"""From raw documents to the plays, searches and playlist tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import values as V
from ..functions import json as J

# Keys of a play record. Names skip empty values of any type; the
# fields need to tell a missing key from null or a number from a text.
_PLAY_NAMES = (
    "ts", "master_metadata_track_name", "trackName", "master_metadata_album_artist_name",
    "artistName", "master_metadata_album_album_name", "albumName",
)
_PLAY_FIELDS = ("endTime", "ms_played", "msPlayed", "skipped", "shuffle", "offline")
_PLAY_ATTRIBUTES = ("platform", "reason_start", "reason_end", "conn_country")
# Keys of a search record and of a playlist.
_SEARCH_FIELDS = ("searchTime", "platform", "searchQuery", "searchInteractionURIs")
_PLAYLIST_FIELDS = ("name", "items", "collaborative", "lastModifiedDate", "description")


def play_time(rec: Column) -> Column:
    """Time text of a play from either dialect, unwrapping ``{"$date": ...}``."""
    own = F.when(~rec["ts"].isin("", "{}"), rec["ts"])
    end = F.when(rec["endTime"].isNull(), "").otherwise(J.text(rec["endTime"]))
    chosen = F.coalesce(own, end)
    inner = F.try_variant_get(F.try_parse_json(chosen), "$['$date']", "variant")
    unwrapped = F.when(inner.isNotNull(), J.text(inner)).otherwise(chosen)
    return F.when(chosen.startswith("{"), unwrapped).otherwise(chosen)


def play_ms(rec: Column) -> Column:
    """Milliseconds of a play; NULL where the value given is no number."""
    own = rec["ms_played"]
    other = F.when(rec["msPlayed"].isNull(), 0.0).otherwise(J.number(rec["msPlayed"]))
    given = F.try_variant_get(own, "$", "double")
    # A number needs one look; texts and other values are told apart with more care.
    careful = (
        F.when(~J.is_text(own) & given.isNotNull(), F.when(given != 0, given).otherwise(other))
        .when(J.first_filled(own).isNotNull(), J.number(own))
        .otherwise(other)
    )
    return F.when(own.isNull(), other).otherwise(J.let(
        J.plain_number(own), lambda n: F.when(n.isNull(), careful).when(n != 0, n).otherwise(other)))


def _name(rec: Column, *keys: str) -> Column:
    return F.coalesce(*[F.when(rec[k] != "", rec[k]) for k in keys], F.lit(C.UNKNOWN))


def plays(
    docs: DataFrame,
    max_rows_per_file: int | None = None,
    strict_none: bool = False,
    keep_unreadable: bool = False,
) -> DataFrame:
    """Normalise streaming-history documents to one row per play.

    A record that cannot be read is dropped alone. Texts are kept whole. ``max_rows_per_file``
    turns on stride sampling, for looking at a part of large files; the ingest never does. ``strict_none`` writes ``None`` for an explicit JSON null.
    ``keep_unreadable`` keeps a row with NULL ``pos`` per file that is no list.
    """
    # Only the strict form has to tell null from a missing key.
    fields, texts = _PLAY_FIELDS, _PLAY_ATTRIBUTES
    if strict_none:
        fields, texts = _PLAY_FIELDS + _PLAY_ATTRIBUTES, ()

    def attribute(key: str) -> Column:
        if strict_none:
            return J.text_or(rec[key], C.UNKNOWN, "None").alias(key)
        return F.coalesce(rec[key], F.lit(C.UNKNOWN)).alias(key)

    rec = F.col("rec")
    rows = J.records(
        docs.where(F.col("kind") == "plays"), fields, texts, _PLAY_NAMES,
        max_rows_per_file, keep_unreadable,
    )
    # A condition on the milliseconds must not compute them again.
    wanted = F.col("msPlayed").isNotNull()
    if keep_unreadable:
        wanted = wanted | F.col("pos").isNull()
    named = J.once(rows, msPlayed=play_ms(rec)).where(wanted).select(
        "profile", F.col("file_name").alias("source_file"), "pos",
        "msPlayed", play_time(rec).alias("ts"),
        _name(rec, "master_metadata_track_name", "trackName").alias("trackName"),
        _name(rec, "master_metadata_album_artist_name", "artistName").alias("artistName"),
        _name(rec, "master_metadata_album_album_name", "albumName").alias("albumName"),
        attribute("platform"),
        *[J.flag(rec[f]).alias(f) for f in ("skipped", "shuffle", "offline")],
        *[attribute(key) for key in ("reason_start", "reason_end", "conn_country")],
    )
    # A missing name reads "Unknown", so no track name is ever empty here.
    dated = named.withColumn("year", V.year_of("ts"))
    return with_derived(dated).select(*schemas.columns(schemas.PLAYS))


def with_derived(rows: DataFrame) -> DataFrame:
    """Add the derived play columns to rows that hold ``msPlayed, skipped, ts``."""
    return rows.withColumns({
        "minutesPlayed": V.minutes("msPlayed"),
        "hoursPlayed": V.hours("msPlayed"),
        "playType": V.play_type("msPlayed"),
        "completion": V.completion("skipped"),
        "year_month": V.month_key("ts"),
        "date": V.date_key("ts"),
    })


def searches(
    docs: DataFrame, max_rows_per_file: int | None = None, strict_none: bool = False
) -> DataFrame:
    """Normalise search-history documents; a bad record is dropped alone."""
    null_text = "None" if strict_none else None
    rec = F.col("rec")
    time, uris = rec["searchTime"], rec["searchInteractionURIs"]
    time_is_text = time.isNull() | F.is_variant_null(time) | (F.schema_of_variant(time) == "STRING")
    kind = F.schema_of_variant(uris)
    # The length of a list, a text or an object; other values have none and drop the record.
    links = (
        F.when(uris.isNull(), 0)
        .when(kind.startswith("ARRAY"), F.size(J.items(uris)))
        .when(kind == "STRING", F.length(J.text(uris)))
        .when(kind.startswith("OBJECT"), F.size(F.try_variant_get(uris, "$", "map<string, variant>")))
    )
    rows = J.once(
        J.records(
            docs.where(F.col("kind") == "searches"), _SEARCH_FIELDS, per_file=max_rows_per_file
        ),
        searchTime=F.when(time.isNull(), "").otherwise(J.text(time)),
        platform=J.text_or(rec["platform"], C.UNKNOWN, null_text or C.UNKNOWN),
        searchQuery=J.text_or(rec["searchQuery"], "", null_text or ""),
        _links=F.when(time_is_text, links),
    )
    return (
        rows.where(F.col("_links") >= 0)
        .withColumn("year", V.year_of("searchTime"))
        .withColumn("hasInteractions", F.col("_links") > 0)
        .select(*schemas.columns(schemas.SEARCHES))
    )


def _playlists(docs: DataFrame) -> DataFrame:
    """One row per playlist object: ``profile, p`` with its fields as VARIANTs."""
    lists = J.with_document(docs)
    found = F.try_variant_get("doc", "$.playlists", "array<variant>")
    rows = lists.select("profile", F.explode_outer(found).alias("_playlist"))
    return J.once(rows, p=J.record("_playlist", _PLAYLIST_FIELDS)).where("p IS NOT NULL")


def playlists(docs: DataFrame, strict_none: bool = False) -> DataFrame:
    """One row per named playlist with at least one item, minutes estimated."""
    null_text = "None" if strict_none else None
    p = F.col("p")
    tracks = F.when(p["items"].isNull(), F.lit(0)).otherwise(F.size(J.items(p["items"])))
    modified = p["lastModifiedDate"]
    rows = J.once(
        _playlists(docs.where(F.col("kind") == "playlists")),
        _name=J.text_or(p["name"], C.UNKNOWN_PLAYLIST, null_text or C.UNKNOWN),
        trackCount=tracks,
        collaborative=J.flag(p["collaborative"]),
        lastModified=F.when(modified.isNull(), "").otherwise(J.text(modified)),
        description=J.text_or(p["description"], "", null_text or ""),
    )
    return (
        rows.where((F.col("trackCount") > 0) & (F.col("_name") != C.UNKNOWN_PLAYLIST))
        .withColumnRenamed("_name", "playlistName")
        .withColumn("totalMinutes", V.playlist_minutes("trackCount"))
        .select(*schemas.columns(schemas.PLAYLISTS))
    )


def playlist_items(docs: DataFrame) -> DataFrame:
    """One row per usable song of every playlist; a bad item is dropped alone."""
    p = F.col("p")
    # The name is taken before the explode, so that no song row carries the playlist, and the
    # songs by one typed cast of the list.
    songs = F.try_variant_get(
        p["items"], "$", "array<struct<track: struct<trackName: string, artistName: string>>>")
    named = _playlists(docs.where(F.col("file_name").contains("Playlist"))).select(
        "profile",
        J.text_or(p["name"], C.UNKNOWN, C.UNKNOWN).alias("playlistName"),
        songs["track"].alias("_songs"),
    )
    names = named.select("profile", "playlistName", F.inline("_songs").alias("_track", "_artist"))
    titled = J.once(names, trackName=_stripped(F.col("_track")), artistName=_stripped(F.col("_artist")))
    usable = V.known("trackName", "artistName", unknown=C.UNKNOWN_ITEM_NAMES)
    return titled.where(usable).select(*schemas.columns(schemas.PLAYLIST_ITEMS))


# The characters of Unicode's property White_Space.
_WHITE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _stripped(name: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.trim(name, F.lit(_WHITE))
