"""Names, limits and defaults that results depend on."""

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values of the export format and of the
# reports users already know; changing one changes results.
# ---------------------------------------------------------------------------

# Words that mean "no name", compared in lower case.
UNKNOWN_NAMES = ("unknown", "n/a", "", "null")
# Playlist items use a shorter list.
UNKNOWN_ITEM_NAMES = ("unknown", "n/a", "")

UNKNOWN = "Unknown"
UNKNOWN_PLAYLIST = "Unknown Playlist"
DEFAULT_YEAR = 2023
MIN_YEAR = 1900
COMPLETE_MS = 30000
MS_PER_MINUTE = 60000
MS_PER_HOUR = 3600000
MINUTES_PER_TRACK = 3.5
MIN_LOYAL_MINUTES = 60
DAYS_PER_PLAY = 10
SPAN_WITHOUT_DATES = 365
DAYS_PER_YEAR = 365.25
MONTHS_FOR_TREND = 5

# Length to which a list of options or a table may cut the names it shows. Stored names are whole.
NAME_CHARS = 100

# Sizes of lists and reports.
RECENT_PROMPTS = 10
RECENT_PAYMENTS = 5
FAVOURITES = 3
TOP_ARTISTS = 15
TOP_ALBUMS = 15
TOP_TRACKS = 25
TOP_PER_YEAR = 20
TOP_PER_YEAR_BAR = 10
TOP_LOYALTY = 20
TOP_MOST_LOYAL = 10
TOP_SHARED_SONGS = 25
TOP_PLAYLISTS = 10
NAMES_SAMPLED = 3
OPTION_PREVIEW = 100
SUGGESTIONS = 5

# Columns that may hold the time of a play, in order of preference.
TIMESTAMP_COLUMNS = (
    "ts", "endTime", "played_at", "timestamp", "date", "playedAt", "end_time",
)

# Columns beyond the plain history, listed in the insights summary.
ENHANCED_COLUMNS = (
    "platform", "skipped", "shuffle", "offline", "reason_start", "reason_end",
    "conn_country", "minutesPlayed", "playType", "completion",
)

# Export file names and the kind of record each holds. The first match wins.
FILE_ROUTES = (
    ("plays", "contains", "Streaming_History"),
    ("plays", "contains", "StreamingHistory"),
    ("account", "equals", "Userdata.json"),
    ("library", "equals", "YourLibrary.json"),
    ("searches", "equals", "SearchQueries.json"),
    ("wrapped", "contains", "Wrapped"),
    ("playlists", "contains", "Playlist"),
    ("follow", "equals", "Follow.json"),
    ("prompts", "equals", "UserPrompts.json"),
    ("podcasts", "equals", "PodcastInteractivityVotedPollOption.json"),
    ("addresses", "equals", "UserAddress.json"),
    ("identifiers", "equals", "Identifiers.json"),
    ("purchases", "equals", "Purchases.json"),
    ("payments", "equals", "Payments.json"),
    ("catalogued", "equals", "Inferences.json"),
    ("catalogued", "equals", "Marquee.json"),
)
OTHER_KIND = "other"
KINDS = (
    "plays", "account", "library", "searches", "wrapped", "playlists", "follow",
    "prompts", "podcasts", "addresses", "identifiers", "purchases", "payments",
    "catalogued",
)

# ---------------------------------------------------------------------------
# Engine limits. These steer plans and never change a result.
# ---------------------------------------------------------------------------

# Buckets that profiles are dealt to by a hash of their name, in every stored table.
BUCKETS = 256
# A side of a join is broadcast only after a count shows at most this many rows.
BROADCAST_ROWS = 200000
# Longest value list written into a predicate; longer lists become a semi-join.
INLINE_VALUES = 1000
# Sub-groups a hot key is split into where a plan salts.
SALTS = 64
# Tables that an ingest writes at the same time.
TABLES_AT_A_TIME = 4
