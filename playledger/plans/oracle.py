"""The same queries as plain SQL over the test tables, for checking results."""

from __future__ import annotations

from .. import constants as C
from .catalog import FIRST_ARTISTS, MANY_ARTISTS, SELECTION

_SOLD = """lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""

_TRACK = "CASE p_size WHEN 1 THEN 'Unknown' WHEN 2 THEN 'N/A' WHEN 3 THEN '' ELSE p_name END"
_ALBUM = "CASE p_size WHEN 4 THEN 'null' WHEN 5 THEN 'UNKNOWN' ELSE p_brand END"

_PLAY_COLUMNS = f"""
    {_TRACK} AS trackName, s_name AS artistName, {_ALBUM} AS albumName,
    CAST(year(l_shipdate) AS INT) AS year, CAST(l_quantity * 1200 AS DOUBLE) AS msPlayed,
    CAST(l_shipdate AS VARCHAR) AS ts,
    CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS skipped"""

_PLAYS = f"plays AS (SELECT l_linestatus AS profile, {_PLAY_COLUMNS} FROM {_SOLD})"
_CUSTOMER_PLAYS = f"""plays AS (SELECT 'c' || o_custkey AS profile, {_PLAY_COLUMNS}
    FROM {_SOLD} JOIN orders ON l_orderkey = o_orderkey)"""
_EVENT_PLAYS = """event_plays AS (
    SELECT 'e' AS profile, event_type AS trackName, CAST(user_id AS VARCHAR) AS artistName,
        'Unknown' AS albumName, CAST(year(ts) AS INT) AS year,
        round_even(value * 1000, 0) AS msPlayed, CAST(ts AS VARCHAR) AS ts,
        CAST(NULL AS BOOLEAN) AS skipped
    FROM events)"""
_ITEMS = f"""items AS (SELECT l_linestatus AS profile, 'O' || l_orderkey AS playlistName,
    p_name AS trackName, s_name AS artistName FROM {_SOLD})"""
_SEARCHES = """searches AS (SELECT 'c' || user_id AS profile FROM events)"""

_LABEL = "trackName || ' - ' || artistName"


def _known(*names: str) -> str:
    return " AND ".join(f"lower({n}) NOT IN ('unknown', 'n/a', '', 'null')" for n in names)


def _list(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def _top(names: str, k: int, by: str = "profile", where: str = "true", extra: str = "") -> str:
    cols = f"{by}, {names}" if by else names
    part = f"PARTITION BY {by}" if by else ""
    return f"""WITH {_PLAYS}, totals AS (
        SELECT {cols}, sum(msPlayed) / 60000 AS totalMinutes FROM plays
        WHERE {_known(*names.split(', '))} AND {where} GROUP BY {cols}),
    ranked AS (SELECT *, row_number() OVER ({part} ORDER BY totalMinutes DESC, {names}) AS rn
        FROM totals)
    SELECT {cols}, totalMinutes, totalMinutes / 60 AS totalHours{extra} FROM ranked WHERE rn <= {k}"""


_BY_LABEL = f", {_LABEL} AS trackLabel"
_YEARS = "profile, year"


def _month(rows: str, month: str) -> str:
    return f"""WITH {_PLAYS}, months AS (
        SELECT profile, {month} AS year_month, msPlayed FROM {rows} WHERE year > 1900)
    SELECT profile, year_month, sum(msPlayed) / 60000 AS totalMinutes,
        sum(msPlayed) / 60000 / 60 AS totalHours
    FROM months WHERE year_month IS NOT NULL GROUP BY ALL"""


def _trend(base: str, rows: str) -> str:
    return f"""WITH {base}, grains AS (
        SELECT profile, 'month' AS grain, substr(ts, 1, 7) AS period, msPlayed
        FROM {rows} WHERE year > 1900 AND ts IS NOT NULL
        UNION ALL
        SELECT profile, 'year', CAST(year AS VARCHAR), msPlayed FROM {rows} WHERE year > 1900),
    totals AS (SELECT profile, grain, period, sum(msPlayed) / 60000 AS totalMinutes
        FROM grains GROUP BY ALL),
    counted AS (SELECT *, count(*) FILTER (grain = 'month') OVER (PARTITION BY profile) AS months
        FROM totals)
    SELECT profile, grain, period, totalMinutes, totalMinutes / 60 AS totalHours FROM counted
    WHERE grain = CASE WHEN months > 5 THEN 'month' ELSE 'year' END"""


def _stats(hours: str) -> str:
    return f"""WITH {_PLAYS} SELECT profile, count(*) AS records, count(DISTINCT year) AS years,
        count(DISTINCT artistName) AS artists, count(DISTINCT albumName) AS albums,
        count(DISTINCT trackName) AS tracks, {hours} AS totalHours
    FROM plays GROUP BY profile"""


_LOYALTY = f"""WITH {_PLAYS}, artists AS (
        SELECT profile, artistName, min(substr(ts, 1, 10)) AS first_listen,
            max(substr(ts, 1, 10)) AS last_listen, sum(msPlayed) / 60000 AS totalMinutes,
            count(DISTINCT substr(ts, 1, 10)) AS unique_days
        FROM plays WHERE {_known('artistName')} GROUP BY profile, artistName),
    kept AS (SELECT *, CAST(date_diff('day', CAST(first_listen AS DATE),
            CAST(last_listen AS DATE)) AS INT) AS span_days,
            row_number() OVER (PARTITION BY profile ORDER BY totalMinutes DESC, artistName) AS rn
        FROM artists WHERE totalMinutes >= 60),
    scored AS (SELECT profile, artistName, first_listen, last_listen, totalMinutes, unique_days,
            span_days, round_even(unique_days / (span_days + 1) * 100, 1) AS loyalty_score
        FROM kept WHERE rn <= 20)"""

_COUNTS = """count(*) AS records, count(DISTINCT artistName) AS artists, sum(msPlayed) AS ms"""

_OPTIONS = f"""{_PLAYS}, options AS (
        SELECT DISTINCT profile, 'year' AS facet, CAST(year AS VARCHAR) AS value FROM plays
        UNION SELECT profile, 'artist', artistName FROM plays
        UNION SELECT profile, 'album', albumName FROM plays
        UNION SELECT profile, 'song', trackName FROM plays)"""

_TOP_PLAYLISTS = f"""WITH {_ITEMS}, lists AS (
        SELECT profile, playlistName, count(*) AS trackCount, count(*) * 3.5::DOUBLE AS totalMinutes
        FROM items GROUP BY profile, playlistName),
    ranked AS (SELECT *, row_number() OVER
            (PARTITION BY profile ORDER BY totalMinutes DESC, playlistName) AS rn FROM lists)"""

_DERIVED = """msPlayed / 60000 AS minutesPlayed, msPlayed / 3600000 AS hoursPlayed,
    CASE WHEN msPlayed > 30000 THEN 'Complete' ELSE 'Partial' END AS playType,
    CASE WHEN skipped THEN 'Skipped' ELSE 'Completed' END AS completion,
    substr(ts, 1, 7) AS year_month, substr(ts, 1, 10) AS date"""

_SHOWN = f"""CASE WHEN {_TRACK} = '' THEN 'Unknown' ELSE {_TRACK} END"""
_DAY = "strftime(l_shipdate, '%Y-%m-%d')"

_WORDS = """words AS (SELECT 'd' || doc_id AS profile, lang, source, text,
    string_split(text, ' ') AS ws FROM documents)"""
# One row per word with its position in the text, from 0.
_EACH = f"""{_WORDS}, each AS (SELECT profile, lang, source, len(ws) AS n,
    unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM words)"""


def _sorted(values: str) -> str:
    """Sorted distinct values of a list as text; empty text for an empty list."""
    return f"coalesce(array_to_string(list_sort(list_distinct({values})), '|'), '')"


_FILE_NAME = """CASE o_orderpriority || '/' || o_orderstatus
    WHEN '1-URGENT/F' THEN 'Streaming_History_Audio_1.json'
    WHEN '1-URGENT/O' THEN 'StreamingHistory1.json'
    WHEN '1-URGENT/P' THEN 'Userdata.json'
    WHEN '2-HIGH/F' THEN 'YourLibrary.json'
    WHEN '2-HIGH/O' THEN 'SearchQueries.json'
    WHEN '2-HIGH/P' THEN 'Wrapped2024.json'
    WHEN '3-MEDIUM/F' THEN 'Playlist1.json'
    WHEN '3-MEDIUM/O' THEN 'Follow.json'
    WHEN '3-MEDIUM/P' THEN 'UserPrompts.json'
    WHEN '4-NOT SPECIFIED/F' THEN 'PodcastInteractivityVotedPollOption.json'
    WHEN '4-NOT SPECIFIED/O' THEN 'UserAddress.json'
    WHEN '4-NOT SPECIFIED/P' THEN 'Identifiers.json'
    WHEN '5-LOW/F' THEN 'Purchases.json'
    WHEN '5-LOW/O' THEN 'Payments.json'
    WHEN '5-LOW/P' THEN 'Marquee.json'
    ELSE 'ReadMe.json' END"""
_KIND = """CASE
    WHEN file_name LIKE '%Streaming%History%' THEN 'plays'
    WHEN file_name = 'Userdata.json' THEN 'account'
    WHEN file_name = 'YourLibrary.json' THEN 'library'
    WHEN file_name = 'SearchQueries.json' THEN 'searches'
    WHEN file_name LIKE 'Wrapped%' THEN 'wrapped'
    WHEN file_name LIKE 'Playlist%' THEN 'playlists'
    WHEN file_name = 'Follow.json' THEN 'follow'
    WHEN file_name = 'UserPrompts.json' THEN 'prompts'
    WHEN file_name LIKE 'Podcast%' THEN 'podcasts'
    WHEN file_name = 'UserAddress.json' THEN 'addresses'
    WHEN file_name = 'Identifiers.json' THEN 'identifiers'
    WHEN file_name = 'Purchases.json' THEN 'purchases'
    WHEN file_name = 'Payments.json' THEN 'payments'
    WHEN file_name = 'Marquee.json' THEN 'catalogued'
    ELSE 'other' END"""
_FILES = f"""named AS (SELECT 'c' || o_custkey AS profile, {_FILE_NAME} AS file_name,
        o_orderkey AS file_size, o_orderdate AS modified FROM orders),
    files AS (SELECT *, {_KIND} AS kind FROM named)"""
_KINDS = (
    "plays account library searches wrapped playlists follow prompts podcasts addresses "
    "identifiers purchases payments catalogued"
).split()

ORACLE: dict[str, str] = {
    "top_artists": _top("artistName", 15),
    "top_artists_overall": _top("artistName", 15, by=""),
    "derived_flags": f"""WITH {_PLAYS} SELECT profile, trackName, substr(ts, 1, 10) AS ts,
        {_DERIVED} FROM plays""",
    "record_counts": f"""WITH {_PLAYS} SELECT profile, count(*) AS totalRecords,
        count(*) AS filteredRecords FROM plays GROUP BY profile""",
    "quick_stats": _stats("sum(msPlayed) / 3600000"),
    "quick_stats_display": _stats("round_even(sum(msPlayed) / 3600000, 1)"),
    "quick_stats_from_rollup": _stats("sum(msPlayed) / 3600000"),
    "quick_stats_estimated": f"""WITH exact AS ({_stats("sum(msPlayed) / 3600000")})
        SELECT profile, records, years, totalHours, artists, albums, tracks,
            true AS artists_near, true AS albums_near, true AS tracks_near FROM exact""",
    "play_rollup": f"""WITH {_PLAYS} SELECT profile, year, substr(ts, 1, 7) AS year_month,
        artistName, albumName, trackName, sum(msPlayed) AS msPlayed, count(*) AS plays
        FROM plays GROUP BY ALL""",
    "top3_artists": _top("artistName", 3),
    "top3_albums": _top("albumName", 3),
    "top3_songs": _top("trackName", 3),
    "top_tracks": _top("trackName, artistName", 25, extra=_BY_LABEL),
    "top_albums": _top("albumName", 15),
    "top_artists_by_year": _top("artistName", 20, _YEARS, "year > 1900"),
    "top_artists_by_year_bar": _top("artistName", 10, _YEARS, "year > 1900"),
    "top_tracks_by_year": _top("trackName, artistName", 20, _YEARS, "year > 1900", _BY_LABEL),
    "top_albums_by_year": _top("albumName", 20, _YEARS, "year > 1900"),
    "top_albums_of_year": _top("albumName", 20, _YEARS, "year = 1997"),
    "top_tracks_latest_year": _top(
        "trackName, artistName", 20, _YEARS,
        "year = (SELECT max(year) FROM plays AS p WHERE p.profile = plays.profile)", _BY_LABEL),
    "trend_monthly": _month("plays", "substr(ts, 1, 7)"),
    "trend_monthly_parsed": _month("plays", "strftime(CAST(ts AS TIMESTAMP), '%Y-%m')"),
    "trend_monthly_other_column": _month("plays", "substr(ts, 1, 7)"),
    "trend_yearly": f"""WITH {_PLAYS} SELECT profile, year, sum(msPlayed) / 60000 AS totalMinutes,
        sum(msPlayed) / 60000 / 60 AS totalHours FROM plays WHERE year > 1900 GROUP BY ALL""",
    "trend_auto_plays": _trend(_PLAYS, "plays"),
    "trend_auto_events": _trend(_EVENT_PLAYS, "event_plays"),
    "first_timestamp": f"""WITH {_EVENT_PLAYS} SELECT trackName,
        CASE WHEN msPlayed > 10000 THEN substr(ts, 1, 19) ELSE substr(ts, 1, 10) END AS time,
        count(*) AS n FROM event_plays GROUP BY ALL""",
    "artist_loyalty": f"{_LOYALTY} SELECT * FROM scored",
    "artist_loyalty_from_days": f"{_LOYALTY} SELECT * FROM scored",
    "artist_loyalty_from_bits": f"{_LOYALTY} SELECT * FROM scored",
    "loyalty_no_ts": f"""WITH {_PLAYS}, artists AS (
            SELECT profile, artistName, sum(msPlayed) / 60000 AS totalMinutes,
                count(*) AS play_count
            FROM plays WHERE {_known('artistName')} GROUP BY profile, artistName),
        kept AS (SELECT *, play_count * 10 AS unique_days, 365 AS span_days, row_number() OVER
                (PARTITION BY profile ORDER BY totalMinutes DESC, artistName) AS rn
            FROM artists WHERE totalMinutes >= 60)
        SELECT profile, artistName, totalMinutes, play_count, unique_days, span_days,
            round_even(unique_days / 366 * 100, 1) AS loyalty_score FROM kept WHERE rn <= 20""",
    "most_loyal": f"""{_LOYALTY}, best AS (SELECT *, row_number() OVER (PARTITION BY profile
            ORDER BY loyalty_score DESC, totalMinutes DESC, artistName) AS place FROM scored)
        SELECT profile, artistName, CAST(round_even(totalMinutes, 0) AS BIGINT) AS totalMinutes,
            loyalty_score, span_days, unique_days FROM best WHERE place <= 10""",
    "filter_all": f"""WITH {_PLAYS}, hits AS (SELECT * FROM plays
            WHERE year IN ({_list(SELECTION.years)}) AND artistName IN ({_list(FIRST_ARTISTS)})
            AND albumName IN ({_list(SELECTION.albums)}) AND trackName IN ({_list(SELECTION.songs)})),
        kept AS (SELECT * FROM hits UNION ALL SELECT * FROM plays
            WHERE profile NOT IN (SELECT profile FROM hits))
        SELECT profile, {_COUNTS} FROM kept GROUP BY profile""",
    "filter_long_list": f"""WITH {_PLAYS} SELECT profile, {_COUNTS} FROM plays
        WHERE artistName IN ({_list(MANY_ARTISTS)}) AND year = 1999 GROUP BY profile""",
    "filter_fallback": f"""WITH {_PLAYS}, {_EVENT_PLAYS},
        both_ AS (SELECT * FROM plays UNION ALL SELECT * FROM event_plays),
        hits AS (SELECT * FROM both_ WHERE year = 1996),
        kept AS (SELECT * FROM hits UNION ALL SELECT * FROM both_
            WHERE profile NOT IN (SELECT profile FROM hits))
        SELECT profile, {_COUNTS} FROM kept GROUP BY profile""",
    "filter_nothing_left": f"WITH {_PLAYS} SELECT profile, {_COUNTS} FROM plays GROUP BY profile",
    "filter_overall": f"""WITH {_PLAYS} SELECT profile, {_COUNTS} FROM plays WHERE year = 1996
        GROUP BY profile""",
    "facets": f"WITH {_OPTIONS} SELECT profile, facet, value FROM options",
    "facets_after_changes": f"""WITH {_PLAYS}, {_EVENT_PLAYS}, every AS (
            SELECT profile, year, artistName, albumName, trackName FROM plays WHERE year <> 1996
            UNION ALL SELECT profile, year, artistName, albumName, trackName FROM event_plays),
        pairs AS (SELECT profile, 'year' AS facet, CAST(year AS VARCHAR) AS value FROM every
            UNION ALL SELECT profile, 'artist', artistName FROM every
            UNION ALL SELECT profile, 'album', albumName FROM every
            UNION ALL SELECT profile, 'song', trackName FROM every)
        SELECT profile, facet, value, count(*) AS n FROM pairs WHERE value IS NOT NULL GROUP BY ALL""",
    "available_years": f"WITH {_PLAYS} SELECT DISTINCT profile, year FROM plays",
    "year_span": f"""WITH {_PLAYS} SELECT profile, max(year) - min(year) + 1 AS years_span
        FROM plays GROUP BY profile""",
    "option_search": f"""WITH {_OPTIONS} SELECT profile, value FROM options
        WHERE facet = 'song' AND contains(lower(trim(value)), 'widget')""",
    "option_search_indexed": f"""WITH {_OPTIONS} SELECT profile, value FROM options
        WHERE facet = 'song' AND contains(lower(trim(value)), 'widget')""",
    "names_shown": f"SELECT doc_id, substr(text, 1, {C.NAME_CHARS}) AS name FROM documents",
    "option_preview": f"""WITH {_OPTIONS}, ranked AS (SELECT profile, value,
            row_number() OVER (PARTITION BY profile ORDER BY value) AS rn
            FROM options WHERE facet = 'artist')
        SELECT profile, value FROM ranked WHERE rn <= 100""",
    "option_suggest": f"""WITH {_OPTIONS}, ranked AS (SELECT profile, value,
            row_number() OVER (PARTITION BY profile ORDER BY value) AS rn
            FROM options WHERE facet = 'song' AND regexp_matches(lower(value), '[xylophone]'))
        SELECT profile, value FROM ranked WHERE rn <= 5""",
    "prune_selection": f"""WITH {_OPTIONS} SELECT profile, facet, value FROM options
        WHERE (facet, value) IN (('year', '1996'), ('year', '1850'),
            ('artist', '{FIRST_ARTISTS[0]}'), ('artist', 'nobody'), ('song', 'red widget'))""",
    "songs_in_most_playlists": f"""WITH {_ITEMS}, pairs AS (
            SELECT DISTINCT profile, trackName, artistName, playlistName FROM items),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY profile, trackName, artistName
            ORDER BY playlistName) AS n FROM pairs),
        songs AS (SELECT profile, trackName, artistName, count(*) AS playlistCount,
            string_agg(playlistName, ', ' ORDER BY playlistName) FILTER (n <= 3) AS names
            FROM ordered GROUP BY ALL HAVING count(*) > 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY profile
            ORDER BY playlistCount DESC, trackName, artistName) AS rn FROM songs)
        SELECT profile, trackName, artistName, {_LABEL} AS song, playlistCount,
            names || CASE WHEN playlistCount > 3 THEN '...' ELSE '' END AS playlists
        FROM ranked WHERE rn <= 25""",
    "top_playlists": f"""{_TOP_PLAYLISTS} SELECT profile, playlistName, totalMinutes, trackCount,
        totalMinutes / 60 AS totalHours FROM ranked WHERE rn <= 10""",
    "top_playlists_display": f"""{_TOP_PLAYLISTS} SELECT profile, playlistName AS playlist,
        CAST(round_even(totalMinutes, 0) AS BIGINT) AS minutes, trackCount AS tracks,
        round_even(totalMinutes / 60, 1) AS hours FROM ranked WHERE rn <= 10""",
    "normalize_roundtrip": f"""WITH records AS (
            SELECT l_linestatus AS profile,
                'Streaming_History_Audio_' || l_orderkey || '.json' AS source_file, 0 AS pos,
                {_SHOWN} AS trackName, s_name AS artistName, {_ALBUM} AS albumName,
                CAST(year(l_shipdate) AS INT) AS year, CAST(l_quantity * 1200 AS DOUBLE) AS msPlayed,
                {_DAY} || 'T01:02:03Z' AS ts, p_type AS platform,
                CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS skipped,
                true AS shuffle, false AS offline, 'Unknown' AS reason_start,
                'Unknown' AS reason_end, l_returnflag AS conn_country
            FROM {_SOLD}
            UNION ALL
            SELECT l_linestatus, 'Streaming_History_Audio_' || l_orderkey || '.json',
                CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END,
                {_SHOWN}, s_name, 'Unknown', CAST(year(l_shipdate) AS INT),
                CAST(CAST(l_quantity AS INT) AS DOUBLE), {_DAY} || ' 10:00', 'Unknown', false,
                false, false, 'Unknown', 'Unknown', 'Unknown'
            FROM {_SOLD})
        SELECT *, {_DERIVED} FROM records""",
    "stride_sample": f"""WITH {_EACH} SELECT profile, CAST(pos AS INT) AS pos,
            CASE WHEN w = '' THEN 'Unknown' ELSE w END AS trackName,
            CAST(length(w) AS DOUBLE) AS msPlayed
        FROM each WHERE pos % greatest(1, n // 100) = 0""",
    "searches_normalized": """SELECT 'c' || user_id AS profile,
            CAST(ts AS VARCHAR) AS searchTime, CAST(year(ts) AS INT) AS year,
            event_type AS platform, props AS searchQuery,
            value > 10 AS hasInteractions FROM events""",
    "playlists_normalized": """SELECT lang AS profile, source || '-' || doc_id AS playlistName,
            len(string_split(text, ' ')) * 3.5::DOUBLE AS totalMinutes,
            CAST(len(string_split(text, ' ')) AS INT) AS trackCount, false AS collaborative,
            lang AS lastModified, text AS description FROM documents""",
    "playlist_items_normalized": """WITH songs AS (SELECT lang AS profile,
            source || '-' || doc_id AS playlistName, source AS artistName,
            unnest(string_split(text, ' ')) AS w FROM documents),
        named AS (SELECT *, regexp_replace(w, '^[\\s\\v\\x{85}\\pZ]+|[\\s\\v\\x{85}\\pZ]+$', '', 'g') AS trackName
            FROM songs WHERE length(w) <> 1)
        SELECT profile, playlistName, trackName, artistName FROM named
        WHERE lower(trackName) NOT IN ('unknown', 'n/a', '')
            AND lower(artistName) NOT IN ('unknown', 'n/a', '')""",
    "files_rejected": """SELECT 'd' || doc_id AS profile,
            CASE WHEN source = 'web' THEN 'Follow.json' ELSE 'Userdata.json' END AS file_name,
            CASE WHEN source = 'web' THEN 'follow' ELSE 'account' END AS kind
        FROM documents WHERE lang <> 'en' AND NOT json_valid(text)""",
    "route_files": f"""WITH {_FILES} SELECT kind, file_name, count(*) AS files FROM files
        GROUP BY ALL""",
    "profiles_listed": "SELECT DISTINCT 'c' || o_custkey AS profile FROM orders",
    "profile_fingerprints": f"""WITH {_FILES}, stamps AS (SELECT profile,
            file_name || ':' || epoch_us(modified) || ':' || file_size AS stamp FROM files),
        sums AS (SELECT profile, count(*) AS files,
            sum(CAST('0x' || substr(md5(stamp), 1, 15) AS BIGINT)) AS a,
            sum(CAST('0x' || substr(md5('2' || stamp), 1, 15) AS BIGINT)) AS b
            FROM stamps GROUP BY profile)
        SELECT profile, md5(files || ':' || a || ':' || b) AS fingerprint, files FROM sums""",
    "profiles_changed": """SELECT DISTINCT 'c' || o_custkey AS profile FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
    "ingest_twice": f"""WITH steps AS (SELECT unnest([1, 2, 3]) AS step),
        nations AS (SELECT 'n' || n_nationkey AS profile, n_nationkey, r_name AS region
            FROM nation JOIN region ON n_regionkey = r_regionkey),
        -- Who is there after which run.
        present AS (SELECT step, profile, n_nationkey, region,
                CASE WHEN step > 1 AND region = 'AMERICA' THEN 2 ELSE 1 END AS factor
            FROM steps, nations WHERE region <> CASE WHEN step = 1 THEN 'MIDDLE EAST' ELSE 'ASIA' END),
        sold AS (SELECT step, profile, region, o_orderkey, o_orderkey // 1000 AS block,
                {_SHOWN} AS track, s_name AS artist, {_ALBUM} AS album, l_shipdate AS day,
                l_quantity * 1200 * factor AS ms
            FROM {_SOLD} JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey JOIN present ON c_nationkey = n_nationkey),
        lists AS (SELECT step, profile, o_orderkey, block, count(*) AS n FROM sold
            WHERE step = 1 OR region <> 'EUROPE' GROUP BY ALL),
        searched AS (SELECT step, 'e' || event_id // 1000 AS profile, count(*) AS n,
                count(*) FILTER (value > 10) AS followed
            FROM steps, events GROUP BY ALL),
        files AS (
            SELECT step, profile, 'plays' AS kind, block FROM sold GROUP BY ALL UNION ALL
            SELECT step, profile, 'playlists', block FROM lists GROUP BY ALL UNION ALL
            SELECT step, profile, unnest(['account', 'follow']), 0 FROM present UNION ALL
            SELECT step, profile, 'searches', 0 FROM searched),
        amounts AS (
            SELECT step, 'plays' AS table_name, profile, count(*) AS rows, sum(ms) AS amount
            FROM sold GROUP BY ALL UNION ALL
            SELECT step, 'play_rollup', profile,
                count(DISTINCT (year(day), month(day), artist, album, track)), sum(ms)
            FROM sold GROUP BY ALL UNION ALL
            SELECT step, 'artist_days', profile, count(DISTINCT (artist, CAST(day AS DATE))), sum(ms)
            FROM sold GROUP BY ALL UNION ALL
            SELECT step, 'searches', profile, n, followed FROM searched UNION ALL
            SELECT step, 'playlists', profile, count(*), sum(n) FROM lists GROUP BY ALL UNION ALL
            SELECT step, 'playlist_items', profile, sum(n), 0 FROM lists GROUP BY ALL UNION ALL
            SELECT step, unnest(['account', 'rejected_files']), profile, 1, 0 FROM present UNION ALL
            SELECT step, 'files', profile, count(*), 0 FROM files GROUP BY ALL UNION ALL
            SELECT s.step, 'seen_files', f.profile, count(DISTINCT block), 0
            FROM steps s JOIN files f ON f.step <= s.step AND kind = 'plays' GROUP BY ALL UNION ALL
            SELECT step, 'manifest', profile, 1, count(*) FROM files GROUP BY ALL),
        taken AS (SELECT step, CASE step
                WHEN 1 THEN (SELECT count(DISTINCT profile) FROM files f WHERE f.step = 1)
                WHEN 2 THEN (SELECT count(*) FROM nations WHERE region <> 'AFRICA') -
                    (SELECT count(*) FROM nations WHERE region = 'EUROPE' AND profile NOT IN
                        (SELECT profile FROM files f WHERE f.step = 1 AND kind = 'playlists'))
                ELSE 0 END AS changed FROM steps)
        SELECT CAST(step AS INT) AS step, CAST(changed AS BIGINT) AS changed, table_name, profile,
            CAST(rows AS BIGINT) AS rows, CAST(amount AS DOUBLE) AS amount
        FROM amounts JOIN taken USING (step)""",
    "ingest_report": f"""WITH {_FILES}, {_CUSTOMER_PLAYS}, {_SEARCHES},
        played AS (SELECT profile, count(*) AS n FROM plays GROUP BY profile),
        searched AS (SELECT profile, count(*) AS n FROM searches GROUP BY profile),
        readable AS (SELECT *, (profile, file_name) NOT IN (
            SELECT (profile, file_name) FROM files WHERE file_size % 3 = 0) AS ok FROM files),
        present AS (SELECT profile,
            {', '.join(f"bool_or(kind = '{k}' AND ok) AS has_{k}" for k in _KINDS)}
            FROM readable GROUP BY profile)
        SELECT present.*, coalesce(played.n, 0) AS streaming_records,
            coalesce(searched.n, 0) AS search_records
        FROM present LEFT JOIN played USING (profile) LEFT JOIN searched USING (profile)""",
    "insights_summary": f"""WITH {_CUSTOMER_PLAYS}, {_SEARCHES},
        played AS (SELECT profile, count(*) AS n, CAST(max(year) - min(year) + 1 AS INT) AS span
            FROM plays GROUP BY profile),
        searched AS (SELECT profile, count(*) AS n FROM searches GROUP BY profile),
        people AS (SELECT 'c' || c_custkey AS profile, c_acctbal > 0 AS rich, * FROM customer)
        SELECT profile, played.n IS NOT NULL AS streaming_available,
            coalesce(played.n, 0) AS records, coalesce(span, 0) AS years_span,
            CASE WHEN played.n IS NULL THEN ''
                ELSE 'skipped|minutesPlayed|playType|completion' END AS enhanced_columns,
            true AS account_available, '2020-02-29' AS creation_date, c_mktsegment AS country,
            date_diff('day', DATE '2020-02-29', DATE '2026-01-01') / 365.25::DOUBLE
                AS account_age_years,
            rich AS library_available,
            CASE WHEN rich THEN c_nationkey + 1 ELSE 0 END AS saved_tracks, 0 AS saved_albums,
            CASE WHEN rich THEN 1 ELSE 0 END AS followed_artists, 0 AS followed_shows,
            searched.n IS NOT NULL AS searches_available, coalesce(searched.n, 0) AS search_count,
            NOT rich AS wrapped_available,
            CASE WHEN rich THEN 'Unknown' ELSE CAST(c_nationkey + 2000 AS VARCHAR) END
                AS wrapped_year,
            CASE WHEN rich THEN 0 ELSE c_custkey * 3600 END / 3600000::DOUBLE AS total_hours,
            CAST(CASE WHEN rich THEN 0 ELSE c_nationkey END AS BIGINT) AS unique_artists
        FROM people LEFT JOIN played USING (profile) LEFT JOIN searched USING (profile)""",
    "account_summary": """SELECT 'o' || o_orderkey AS profile, 'u' || o_custkey AS username,
            '' AS email, o_orderpriority AS country, o_orderstatus = 'F' AS createdFromFacebook,
            '' AS birthdate, '' AS gender, '' AS postalCode,
            CASE WHEN o_orderstatus = 'P' THEN 'n/a'
                ELSE strftime(o_orderdate, '%Y-%m-%d') END AS creationTime,
            CASE WHEN o_orderstatus = 'P' THEN 0 ELSE
                date_diff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') / 365.25::DOUBLE
                END AS account_age_years
        FROM orders""",
    "library_counts": f"""WITH {_WORDS} SELECT profile,
            CAST(len(ws) AS INT) AS saved_tracks_count, CAST(len(ws) AS INT) AS saved_albums_count,
            CAST(len(list_filter(ws, lambda w: length(w) > 5)) AS INT) AS followed_artists_count,
            0 AS followed_shows_count, 0 AS saved_episodes_count,
            CAST(len(list_filter(ws, lambda w: length(w) = 1)) AS INT) AS banned_tracks_count,
            0 AS banned_artists_count,
            array_to_string(list_transform(ws, lambda w: source || '/Unknown/' ||
                CASE WHEN w = '' THEN 'Unknown' ELSE w END || '/' || w), '|')
                AS saved_tracks,
            array_to_string(list_transform(ws, lambda w:
                'Unknown/' || repeat(w, 30) || '/'), '|') AS saved_albums
        FROM words""",
    "follow_counts": f"""WITH {_WORDS} SELECT profile, CAST(len(ws) AS INT) AS following_count,
            CAST(len(list_filter(ws, lambda w: length(w) > 4)) AS INT) AS followers_count,
            CAST(len(list_filter(ws, lambda w: length(w) % 3 = 0)) AS INT) AS following_artists,
            CAST(len(list_filter(ws, lambda w: length(w) % 3 = 1)) AS INT) AS following_users,
            CAST(len(list_filter(ws, lambda w: length(w) % 3 = 2)) AS INT) AS following_shows
        FROM words""",
    "prompts_summary": f"""WITH {_WORDS} SELECT profile, CAST(len(ws) AS INT) AS total_prompts,
            {_sorted("list_transform(ws, lambda w: CASE WHEN w = '' THEN 'unknown' ELSE substr(w, 1, 1) END)")}
                AS prompt_types,
            array_to_string(ws, '|') AS prompts, array_to_string(ws[1:10], '|') AS recent_prompts
        FROM words""",
    "podcast_summary": f"""WITH {_WORDS} SELECT profile, CAST(len(ws) AS INT) AS total_interactions,
            array_to_string(list_transform(ws, lambda w: CASE WHEN length(w) > 3 THEN w ELSE '' END), '|')
                AS poll_votes,
            CAST(len(list_distinct(list_filter(ws, lambda w: length(w) > 3))) AS INT)
                AS shows_interacted
        FROM words""",
    "address_summary": f"""WITH {_WORDS} SELECT profile,
            array_to_string(list_transform(ws, lambda w: substr(w, 1, 2)), '|') AS addresses,
            CAST(len(ws) AS INT) AS address_count,
            {_sorted("list_transform(list_filter(ws, lambda w: w <> ''), lambda w: substr(w, 1, 2))")}
                AS countries
        FROM words""",
    "identifiers_summary": """SELECT 'c' || c_custkey AS profile, c_name AS service_id,
            CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS facebook_id,
            CASE WHEN c_nationkey > 12 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS apple_id,
            '' AS google_id, c_acctbal > 0 AS has_facebook, c_nationkey > 12 AS has_apple,
            false AS has_google
        FROM customer""",
    "purchases_summary": f"""WITH {_WORDS} SELECT profile,
            CAST(len(ws) + 1 AS INT) AS total_purchases,
            {_sorted("list_append(list_transform(ws, lambda w: CASE WHEN length(w) % 2 = 0 THEN substr(w, 1, 1) ELSE 'unknown' END), 'unknown')")}
                AS purchase_types,
            CAST(list_sum(list_transform(ws, lambda w: length(w))) AS DOUBLE) AS total_amount,
            {_sorted("list_transform(ws, lambda w: CASE WHEN length(w) % 2 = 0 THEN lang ELSE source END)")}
                AS currencies
        FROM words""",
    "purchases_by_currency": f"""WITH {_EACH}, bought AS (
            SELECT profile, CASE WHEN length(w) % 2 = 0 THEN lang ELSE source END AS currency,
                length(w) AS amount FROM each
            UNION ALL SELECT profile, NULL, 0 FROM words)
        SELECT profile, currency, count(*) AS purchases,
            CAST(sum(amount) AS DOUBLE) AS total_amount FROM bought GROUP BY ALL""",
    "payments_recent": f"""WITH {_WORDS} SELECT profile, CAST(len(ws) AS INT) AS total_payments,
            {_sorted("list_transform(ws, lambda w: substr(w, 1, 1))")} AS payment_methods,
            array_to_string(ws, '|') AS payments, array_to_string(ws[-5:], '|') AS recent_payments
        FROM words""",
    "wrapped_summary": """SELECT 'p' || p_partkey AS profile,
            CAST(p_size + 2000 AS VARCHAR) AS year,
            round_even(p_retailprice * 100, 0) AS total_ms_listened,
            p_name AS most_listened_day, CAST(p_size AS DOUBLE) AS most_listened_day_minutes,
            CAST(0 AS DOUBLE) AS percent_greater_than_users,
            CAST(0 AS DOUBLE) AS top_artist_fan_percentage,
            CAST(p_size AS BIGINT) AS top_track_play_count,
            CAST(0 AS BIGINT) AS distinct_tracks_played,
            CAST(p_partkey AS BIGINT) AS num_unique_artists,
            CAST(len(string_split(p_name, ' ')) AS INT) AS music_evolution_eras
        FROM part""",
    "safe_numeric": """WITH texts AS (SELECT 'd' AS src, doc_id, text FROM documents
            UNION ALL SELECT 'e', event_id, props FROM events)
        SELECT src, doc_id, coalesce(TRY_CAST(regexp_extract(text, '(\\d+\\.?\\d*)', 1) AS DOUBLE), 0)
            AS number FROM texts""",
    "first_available": """SELECT c_custkey,
            CASE WHEN c_acctbal >= 0 AND c_nationkey <= 20 THEN c_acctbal
                WHEN c_nationkey < 23 THEN CAST(c_nationkey AS DOUBLE) ELSE -1 END AS number,
            CASE WHEN c_nationkey > 5 THEN c_acctbal ELSE 0 END AS safe,
            round_even(c_acctbal / 100, 1) AS tenths,
            CAST(round_even(c_acctbal, 0) AS BIGINT) AS units
        FROM customer""",
}
