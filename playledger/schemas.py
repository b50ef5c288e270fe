"""Fixed schemas of the tables the engine writes (in buckets by a hash of ``profile``).

They are DDL texts, so that importing them needs no running session.
"""

from __future__ import annotations

PLAYS = """
    profile STRING, source_file STRING, pos INT,
    trackName STRING, artistName STRING, albumName STRING, year INT,
    msPlayed DOUBLE, ts STRING, platform STRING,
    skipped BOOLEAN, shuffle BOOLEAN, offline BOOLEAN,
    reason_start STRING, reason_end STRING, conn_country STRING,
    minutesPlayed DOUBLE, hoursPlayed DOUBLE, playType STRING,
    completion STRING, year_month STRING, date STRING
"""

SEARCHES = """
    profile STRING, searchTime STRING, year INT, platform STRING,
    searchQuery STRING, hasInteractions BOOLEAN
"""

PLAYLISTS = """
    profile STRING, playlistName STRING, totalMinutes DOUBLE, trackCount INT,
    collaborative BOOLEAN, lastModified STRING, description STRING
"""

PLAYLIST_ITEMS = """
    profile STRING, playlistName STRING, trackName STRING, artistName STRING
"""

ACCOUNT = """
    profile STRING, username STRING, email STRING, country STRING,
    createdFromFacebook BOOLEAN, birthdate STRING, gender STRING,
    postalCode STRING, creationTime STRING, account_age_years DOUBLE
"""

LIBRARY = """
    profile STRING, saved_tracks_count INT, saved_albums_count INT,
    followed_artists_count INT, followed_shows_count INT,
    saved_episodes_count INT, banned_tracks_count INT, banned_artists_count INT,
    saved_tracks ARRAY<STRUCT<artist: STRING, album: STRING, track: STRING, uri: STRING>>,
    saved_albums ARRAY<STRUCT<artist: STRING, album: STRING, uri: STRING>>
"""

WRAPPED = """
    profile STRING, year STRING, total_ms_listened DOUBLE,
    most_listened_day STRING, most_listened_day_minutes DOUBLE,
    percent_greater_than_users DOUBLE, top_artist_fan_percentage DOUBLE,
    top_track_play_count BIGINT, distinct_tracks_played BIGINT,
    num_unique_artists BIGINT, music_evolution_eras INT
"""

FOLLOW = """
    profile STRING, following_count INT, followers_count INT,
    following_artists INT, following_users INT, following_shows INT
"""

PROMPTS = """
    profile STRING, total_prompts INT, prompt_types ARRAY<STRING>,
    prompts ARRAY<STRING>
"""

PODCASTS = """
    profile STRING, total_interactions INT, poll_votes ARRAY<STRING>,
    shows_interacted INT
"""

ADDRESSES = """
    profile STRING, addresses ARRAY<STRING>, address_count INT,
    countries ARRAY<STRING>
"""

IDENTIFIERS = """
    profile STRING, service_id STRING, facebook_id STRING, apple_id STRING,
    google_id STRING, has_facebook BOOLEAN, has_apple BOOLEAN, has_google BOOLEAN
"""

PURCHASES = """
    profile STRING, total_purchases INT, purchase_types ARRAY<STRING>,
    total_amount DOUBLE, currencies ARRAY<STRING>
"""

PAYMENTS = """
    profile STRING, total_payments INT, payment_methods ARRAY<STRING>,
    payments ARRAY<STRING>
"""

MANIFEST = """
    profile STRING, fingerprint STRING, files BIGINT
"""

FILES = """
    profile STRING, file_name STRING, kind STRING, file_size BIGINT,
    modified TIMESTAMP
"""

SEEN_FILES = """
    profile STRING, file_name STRING
"""

REJECTED = """
    profile STRING, file_name STRING, kind STRING
"""

PLAY_ROLLUP = """
    profile STRING, year INT, year_month STRING, artistName STRING, albumName STRING,
    trackName STRING, msPlayed DOUBLE, plays BIGINT
"""

ARTIST_DAYS = """
    profile STRING, artistName STRING, ts STRING, msPlayed DOUBLE, plays BIGINT
"""

TABLES = {
    "plays": PLAYS,
    "play_rollup": PLAY_ROLLUP,
    "artist_days": ARTIST_DAYS,
    "searches": SEARCHES,
    "playlists": PLAYLISTS,
    "playlist_items": PLAYLIST_ITEMS,
    "account": ACCOUNT,
    "library": LIBRARY,
    "wrapped": WRAPPED,
    "follow": FOLLOW,
    "prompts": PROMPTS,
    "podcasts": PODCASTS,
    "addresses": ADDRESSES,
    "identifiers": IDENTIFIERS,
    "purchases": PURCHASES,
    "payments": PAYMENTS,
    "files": FILES,
    "rejected_files": REJECTED,
    "seen_files": SEEN_FILES,
    "manifest": MANIFEST,
}


def columns(ddl: str) -> list[str]:
    """Column names of a schema: the first word of each field outside of brackets."""
    names, depth, start = [], 0, 0
    for i, char in enumerate(f"{ddl},"):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            names.append(ddl[start:i].split()[0])
            start = i + 1
    return names
