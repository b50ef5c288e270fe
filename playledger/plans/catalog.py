"""Every operator as a named query over the generic test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import first_available, first_timestamp, half_even, safe_numeric, whole
from ..functions.values import cut, safe_number
from ..operators import daybits, leaders, loyalty, normalize, option_index, sketches, stats, summaries, trends
from ..operators import facets as facet_ops
from ..operators import playlists as playlist_ops
from ..operators.filters import Selection, apply_filters
from ..sources import adapters as A
from ..sources.files import file_kind, fingerprints, list_profiles, rejected_files
from .cycle import ingest_twice, work_folder
from .ingest import changed_profiles
from .insights import ingest_report, insights_summary
from .rollup import play_rollup

Query = Callable[[SparkSession, str], DataFrame]

# Names used by the filter queries, from the rule the tables name suppliers by.
FIRST_ARTISTS = [f"Supplier#{i:09d}" for i in range(60)]
MANY_ARTISTS = [f"Supplier#{2 * i + 1:09d}" for i in range(1500)]
SELECTION = Selection(
    years=(1996, 1997, 1998), artists=FIRST_ARTISTS,
    albums=[f"Brand#{i}" for i in range(1, 20)],
    songs=("small ring", "red widget", "blue bolt", "large gear"),
)


def _on_plays(report: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf: report(A.plays(spark, sf), **options)


def _member(column: str, key: str) -> Column:
    """The texts under a key of a list of JSON texts, read as one document."""
    whole = F.concat(F.lit("["), F.array_join(column, ","), F.lit("]"))
    read = F.from_json(whole, f"array<struct<`{key}`: string>>")[key]
    # A list with anything but objects is read one by one.
    return F.array_join(F.coalesce(
        read, F.transform(column, lambda p: F.get_json_object(p, f"$.{key}"))), "|")


def _joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def _counts(plays: DataFrame) -> DataFrame:
    """Rows, distinct artists and milliseconds per profile."""
    return plays.groupBy("profile").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("artistName").alias("artists"),
        F.sum("msPlayed").alias("ms"),
    )


def derived_flags(spark: SparkSession, sf: str) -> DataFrame:
    return A.plays(spark, sf).select(
        "profile", "trackName", "ts", "minutesPlayed", "hoursPlayed", "playType", "completion",
        "year_month", "date",
    ).withColumn("ts", F.substring("ts", 1, 10))


def filter_fallback(spark: SparkSession, sf: str) -> DataFrame:
    both = A.plays(spark, sf).unionByName(A.event_plays(spark, sf))
    return _counts(apply_filters(both, Selection(years=(1996,))))


def filter_nothing_left(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(apply_filters(A.plays(spark, sf), Selection(years=(1800,))))


def filter_overall(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(apply_filters(A.plays(spark, sf), Selection(years=(1996,)), by=()))


def option_suggest(spark: SparkSession, sf: str) -> DataFrame:
    options = facet_ops.facets(A.plays(spark, sf))
    return facet_ops.suggest_options(options, "song", "Xylophone")


def prune_selection(spark: SparkSession, sf: str) -> DataFrame:
    options = facet_ops.facets(A.plays(spark, sf))
    chosen = facet_ops.selection_frame(options, {
        "year": [1996, 1850], "artist": [FIRST_ARTISTS[0], "nobody"], "song": ["red widget"],
    })
    return facet_ops.prune_selection(options, chosen)


def trend_other_column(spark: SparkSession, sf: str) -> DataFrame:
    plays = A.plays(spark, sf).drop("year_month", "date").withColumnRenamed("ts", "played_at")
    return trends.monthly_trend(plays)


def first_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.event_plays(spark, sf).drop("date").select(
        F.when(F.col("msPlayed") > 10000, F.substring("ts", 1, 19)).alias("endTime"),
        F.substring("ts", 1, 10).alias("end_time"), "trackName",
    )
    return rows.groupBy("trackName", first_timestamp(rows).alias("time")).agg(
        F.count(F.lit(1)).alias("n")
    )


def loyalty_no_ts(spark: SparkSession, sf: str) -> DataFrame:
    return loyalty.artist_loyalty(A.plays(spark, sf).drop("ts"))


def most_loyal(spark: SparkSession, sf: str) -> DataFrame:
    return loyalty.most_loyal(loyalty.artist_loyalty(A.plays(spark, sf)))


def loyalty_from_days(spark: SparkSession, sf: str) -> DataFrame:
    return loyalty.artist_loyalty(loyalty.artist_days(A.plays(spark, sf)))


def loyalty_from_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of two halves of the plays that share days, as two runs would store them."""
    plays = A.plays(spark, sf)
    even = F.pmod(F.xxhash64("trackName", "ts", "msPlayed"), F.lit(2)) == 0
    runs = [daybits.artist_day_bits(plays.where(half)) for half in (even, ~even)]
    return daybits.loyalty_from_bits(runs[0].unionByName(runs[1]))


def quick_stats_estimated(spark: SparkSession, sf: str) -> DataFrame:
    """Exact counts, and whether those of merged yearly sketches are within five standard errors."""
    roll = play_rollup(A.plays(spark, sf))
    exact, guess = stats.quick_stats(roll), sketches.quick_stats_estimated(sketches.stat_sketches(roll))
    names = ("artists", "albums", "tracks")
    near = [
        (F.abs(F.col(f"g.{n}") - F.col(f"e.{n}")) <= 5 * sketches.STANDARD_ERROR * F.col(f"e.{n}") + 1)
        .alias(f"{n}_near") for n in names
    ]
    return exact.alias("e").join(guess.alias("g"), "profile").select(
        "profile", "g.records", "g.years", "g.totalHours", *[f"e.{n}" for n in names], *near)


def facets_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Counted facets of all plays, after one year's plays went and all events came."""
    plays = A.plays(spark, sf)
    counts = facet_ops.changed_facet_counts(
        facet_ops.facet_counts(plays), A.event_plays(spark, sf), plays.where("year = 1996"))
    return counts.select("profile", "facet", "value", "n")


def option_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark)
    option_index.write_option_index(facet_ops.facets(A.plays(spark, sf)), path)
    return option_index.search_index(spark, path, "song", " WIDGET ")


def names_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Names are stored whole; a report cuts what it shows."""
    return A.table(spark, sf, "documents").select("doc_id", cut("text", C.NAME_CHARS).alias("name"))


def quick_stats_display(spark: SparkSession, sf: str) -> DataFrame:
    return stats.quick_stats_display(stats.quick_stats(A.plays(spark, sf)))


def quick_stats_from_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return stats.quick_stats(play_rollup(A.plays(spark, sf)))


def play_rollup_query(spark: SparkSession, sf: str) -> DataFrame:
    return play_rollup(A.plays(spark, sf))


def top_playlists(spark: SparkSession, sf: str) -> DataFrame:
    return playlist_ops.top_playlists(A.playlists(spark, sf))


def top_playlists_display(spark: SparkSession, sf: str) -> DataFrame:
    shown = playlist_ops.top_playlists_display(top_playlists(spark, sf))
    return shown.toDF("profile", "playlist", "minutes", "tracks", "hours")


def songs_in_most_playlists(spark: SparkSession, sf: str) -> DataFrame:
    return playlist_ops.songs_in_most_playlists(A.playlist_items(spark, sf))


def normalize_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.plays(A.play_docs(spark, sf))


def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.plays(A.word_play_docs(spark, sf), max_rows_per_file=100).select(
        "profile", "pos", "trackName", "msPlayed"
    )


def searches_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.searches(A.search_docs(spark, sf))


def playlists_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.playlists(A.playlist_docs(spark, sf))


def playlist_items_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.playlist_items(A.playlist_docs(spark, sf))


def files_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return rejected_files(A.mixed_docs(spark, sf))


def route_files(spark: SparkSession, sf: str) -> DataFrame:
    files = A.order_files(spark, sf)
    return files.groupBy(file_kind("file_name").alias("kind"), "file_name").agg(
        F.count(F.lit(1)).alias("files")
    )


def profiles_listed(spark: SparkSession, sf: str) -> DataFrame:
    return list_profiles(A.order_files(spark, sf))


def profile_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(A.order_files(spark, sf))


def profiles_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Listing against one in which urgent files were smaller and low ones absent."""
    files = A.order_files(spark, sf)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    earlier = files.where(F.col("o_orderpriority") != "5-LOW").withColumn(
        "file_size", F.col("file_size") - F.when(urgent, 1).otherwise(0)
    )
    return changed_profiles(fingerprints(files), fingerprints(earlier))


def report_of_ingest(spark: SparkSession, sf: str) -> DataFrame:
    files = A.order_files(spark, sf)
    return ingest_report(
        files, A.customer_plays(spark, sf), A.searches(spark, sf), files.where("file_size % 3 = 0")
    )


def insights(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.customer_docs(spark, sf)
    summary = insights_summary(
        docs["profiles"], A.customer_plays(spark, sf),
        summaries.account(docs["account"], "2026-01-01"), summaries.library(docs["library"]),
        A.searches(spark, sf), summaries.wrapped(docs["wrapped"]),
    )
    return summary.withColumn("enhanced_columns", _joined("enhanced_columns"))


def account_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.account(A.account_docs(spark, sf), "2026-01-01")


def library_counts(spark: SparkSession, sf: str) -> DataFrame:
    library = summaries.library(A.word_docs(spark, sf, "YourLibrary.json"))
    tracks = F.transform("saved_tracks", lambda t: F.concat_ws("/", t.artist, t.album, t.track, t.uri))
    albums = F.transform("saved_albums", lambda a: F.concat_ws("/", a.artist, a.album, a.uri))
    return library.withColumns({
        "saved_tracks": F.array_join(tracks, "|"), "saved_albums": F.array_join(albums, "|"),
    })


def follow_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.follow(A.word_docs(spark, sf, "Follow.json"))


def prompts_summary(spark: SparkSession, sf: str) -> DataFrame:
    prompts = summaries.prompts(A.word_docs(spark, sf, "UserPrompts.json"))
    text = lambda column: F.array_join(
        F.transform(column, lambda p: F.get_json_object(p, "$.text")), "|")
    return prompts.select(
        "profile", "total_prompts", _joined("prompt_types"), _member("prompts", "text").alias("prompts"),
        text(summaries.first_prompts()).alias("recent_prompts"),
    )


def podcast_summary(spark: SparkSession, sf: str) -> DataFrame:
    polls = summaries.podcasts(A.word_docs(spark, sf, "PodcastInteractivityVotedPollOption.json"))
    return polls.withColumn("poll_votes", _member("poll_votes", "showName"))


def address_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = summaries.addresses(A.word_docs(spark, sf, "UserAddress.json"))
    return found.select(
        "profile", _member("addresses", "country").alias("addresses"), "address_count", _joined("countries")
    )


def identifiers_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.identifiers(A.identifier_docs(spark, sf))


def purchases_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = summaries.purchases(A.word_docs(spark, sf, "Purchases.json"))
    return found.select(
        "profile", "total_purchases", _joined("purchase_types"), "total_amount",
        _joined("currencies"),
    )


def purchases_by_currency(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.purchases_by_currency(A.word_docs(spark, sf, "Purchases.json"))


def payments_recent(spark: SparkSession, sf: str) -> DataFrame:
    found = summaries.payments(A.word_docs(spark, sf, "Payments.json"))
    notes = lambda column: F.array_join(
        F.transform(column, lambda p: F.get_json_object(p, "$.note")), "|")
    return found.select(
        "profile", "total_payments", _joined("payment_methods"), _member("payments", "note").alias("payments"),
        notes(summaries.last_payments()).alias("recent_payments"),
    )


def wrapped_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.wrapped(A.wrapped_docs(spark, sf))


def safe_numeric_query(spark: SparkSession, sf: str) -> DataFrame:
    texts = A.table(spark, sf, "documents").select(F.lit("d").alias("src"), "doc_id", "text")
    props = A.table(spark, sf, "events").select(F.lit("e"), "event_id", "props")
    return texts.union(props).select("src", "doc_id", safe_numeric("text").alias("number"))


def first_available_query(spark: SparkSession, sf: str) -> DataFrame:
    owed = F.when(F.col("c_acctbal") < 0, float("nan")).when(F.col("c_nationkey") > 20, None)
    return A.table(spark, sf, "customer").select(
        "c_custkey",
        first_available(
            owed.otherwise(F.col("c_acctbal")),
            F.when(F.col("c_nationkey") < 23, F.col("c_nationkey").cast("double")),
            default=-1.0, floats=True,
        ).alias("number"),
        safe_number(F.when(F.col("c_nationkey") > 5, F.col("c_acctbal"))).alias("safe"),
        half_even(F.col("c_acctbal") / 100).alias("tenths"),
        whole("c_acctbal").alias("units"),
    )


def option_search(spark: SparkSession, sf: str) -> DataFrame:
    options = facet_ops.facets(A.plays(spark, sf))
    return facet_ops.search_options(options, "song", " WIDGET ")


def option_preview(spark: SparkSession, sf: str) -> DataFrame:
    return facet_ops.search_options(facet_ops.facets(A.plays(spark, sf)), "artist")


def _filtered(selection: Selection) -> Query:
    return lambda spark, sf: _counts(apply_filters(A.plays(spark, sf), selection))


QUERIES: dict[str, Query] = {
    "top_artists": _on_plays(leaders.top_artists),
    "top_artists_overall": _on_plays(leaders.top_artists, by=()),
    "derived_flags": derived_flags,
    "record_counts": _on_plays(stats.record_counts),
    "quick_stats": _on_plays(stats.quick_stats),
    "quick_stats_display": quick_stats_display,
    "quick_stats_from_rollup": quick_stats_from_rollup,
    "quick_stats_estimated": quick_stats_estimated,
    "play_rollup": play_rollup_query,
    "top3_artists": _on_plays(leaders.top_artists, k=C.FAVOURITES),
    "top3_albums": _on_plays(leaders.top_albums, k=C.FAVOURITES),
    "top3_songs": _on_plays(leaders.favourite_songs),
    "top_tracks": _on_plays(leaders.top_tracks),
    "top_albums": _on_plays(leaders.top_albums),
    "top_artists_by_year": _on_plays(leaders.top_artists_by_year),
    "top_artists_by_year_bar": _on_plays(leaders.top_artists_by_year, k=C.TOP_PER_YEAR_BAR),
    "top_tracks_by_year": _on_plays(leaders.top_tracks_by_year),
    "top_albums_by_year": _on_plays(leaders.top_albums_by_year),
    "top_albums_of_year": _on_plays(leaders.top_albums_by_year, year=1997),
    "top_tracks_latest_year": _on_plays(leaders.top_tracks_by_year, year="latest"),
    "trend_monthly": _on_plays(trends.monthly_trend),
    "trend_monthly_parsed": _on_plays(trends.monthly_trend, parsed=True),
    "trend_monthly_other_column": trend_other_column,
    "trend_yearly": _on_plays(trends.yearly_trend),
    "trend_auto_plays": _on_plays(trends.trend),
    "trend_auto_events": lambda spark, sf: trends.trend(A.event_plays(spark, sf)),
    "first_timestamp": first_time,
    "artist_loyalty": _on_plays(loyalty.artist_loyalty),
    "artist_loyalty_from_days": loyalty_from_days,
    "artist_loyalty_from_bits": loyalty_from_bits,
    "loyalty_no_ts": loyalty_no_ts,
    "most_loyal": most_loyal,
    "filter_all": _filtered(SELECTION),
    "filter_long_list": _filtered(Selection(artists=MANY_ARTISTS, years=(1999,))),
    "filter_fallback": filter_fallback,
    "filter_nothing_left": filter_nothing_left,
    "filter_overall": filter_overall,
    "facets": _on_plays(facet_ops.facets),
    "facets_after_changes": facets_after_changes,
    "available_years": _on_plays(stats.available_years),
    "year_span": _on_plays(stats.year_span),
    "option_search": option_search,
    "option_search_indexed": option_search_indexed,
    "names_shown": names_shown,
    "option_preview": option_preview,
    "option_suggest": option_suggest,
    "prune_selection": prune_selection,
    "songs_in_most_playlists": songs_in_most_playlists,
    "top_playlists": top_playlists,
    "top_playlists_display": top_playlists_display,
    "normalize_roundtrip": normalize_roundtrip,
    "stride_sample": stride_sample,
    "searches_normalized": searches_normalized,
    "playlists_normalized": playlists_normalized,
    "playlist_items_normalized": playlist_items_normalized,
    "files_rejected": files_rejected,
    "route_files": route_files,
    "profiles_listed": profiles_listed,
    "profile_fingerprints": profile_fingerprints,
    "profiles_changed": profiles_changed,
    "ingest_report": report_of_ingest,
    "ingest_twice": ingest_twice,
    "insights_summary": insights,
    "account_summary": account_summary,
    "library_counts": library_counts,
    "follow_counts": follow_counts,
    "prompts_summary": prompts_summary,
    "podcast_summary": podcast_summary,
    "address_summary": address_summary,
    "identifiers_summary": identifiers_summary,
    "purchases_summary": purchases_summary,
    "purchases_by_currency": purchases_by_currency,
    "payments_recent": payments_recent,
    "wrapped_summary": wrapped_summary,
    "safe_numeric": safe_numeric_query,
    "first_available": first_available_query,
}
