"""Listening-history analytics on Spark, over many profiles in one job."""

from .operators.daybits import artist_day_bits, loyalty_from_bits, merge_day_bits
from .operators.facets import (
    changed_facet_counts, facet_counts, facets, prune_selection, search_options, selection_frame,
    suggest_options,
)
from .operators.filters import Selection, apply_filters, select_rows
from .operators.leaders import (
    favourite_songs, top_albums, top_albums_by_year, top_artists, top_artists_by_year,
    top_tracks, top_tracks_by_year,
)
from .operators.loyalty import artist_days, artist_loyalty, most_loyal
from .operators.option_index import search_index, write_option_index
from .operators.playlists import (
    songs_in_most_playlists, top_playlists, top_playlists_display,
)
from .operators.sketches import quick_stats_estimated, stat_sketches
from .operators.stats import (
    available_years, quick_stats, quick_stats_display, record_counts, year_span,
)
from .operators.topk import top_k
from .operators.trends import monthly_trend, trend, yearly_trend
from .plans import ingest, ingest_report, insights_summary, play_rollup
from .session import build_session
from .sources import read_dimensions, read_plays, read_table

__all__ = [
    "Selection", "apply_filters", "artist_day_bits", "artist_days", "artist_loyalty",
    "available_years", "build_session", "changed_facet_counts", "facet_counts", "facets",
    "favourite_songs", "ingest", "ingest_report", "insights_summary", "loyalty_from_bits",
    "merge_day_bits", "monthly_trend", "most_loyal", "play_rollup", "prune_selection",
    "quick_stats", "quick_stats_display", "quick_stats_estimated", "read_dimensions",
    "read_plays", "read_table", "record_counts", "search_index", "search_options",
    "select_rows", "selection_frame", "songs_in_most_playlists", "stat_sketches",
    "suggest_options", "top_albums", "top_albums_by_year", "top_artists",
    "top_artists_by_year", "top_k", "top_playlists", "top_playlists_display",
    "top_tracks", "top_tracks_by_year", "trend", "write_option_index", "year_span",
    "yearly_trend",
]
