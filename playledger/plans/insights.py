"""Per-profile overviews across all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import values as V


def insights_summary(
    profiles: DataFrame,
    plays: DataFrame,
    account: DataFrame,
    library: DataFrame,
    searches: DataFrame,
    wrapped: DataFrame,
) -> DataFrame:
    """Availability and headline figures of each dataset, one row per profile.

    Plays and searches are counted before the joins, so only one row per profile
    is joined. Of several yearly summaries the latest is shown.
    """
    extra = [c for c in C.ENHANCED_COLUMNS if c in plays.columns]
    streaming = plays.groupBy("profile").agg(
        F.count(F.lit(1)).alias("records"),
        (F.max("year") - F.min("year") + 1).cast("int").alias("years_span"),
    )
    searched = searches.groupBy("profile").agg(F.count(F.lit(1)).alias("search_count"))
    yearly = wrapped.groupBy("profile").agg(
        F.max("year").alias("wrapped_year"),
        F.max_by("total_ms_listened", "year").alias("_ms"),
        F.max_by("num_unique_artists", "year").alias("unique_artists"),
    )
    parts = [
        streaming,
        account.select(
            "profile", F.lit(True).alias("_account"),
            F.col("creationTime").alias("creation_date"), "country", "account_age_years",
        ),
        library.select(
            "profile", F.lit(True).alias("_library"),
            F.col("saved_tracks_count").alias("saved_tracks"),
            F.col("saved_albums_count").alias("saved_albums"),
            F.col("followed_artists_count").alias("followed_artists"),
            F.col("followed_shows_count").alias("followed_shows"),
        ),
        searched,
        yearly,
    ]
    joined = reduce(
        lambda left, right: left.join(right, "profile", "left"),
        parts,
        profiles.select("profile").distinct(),
    )
    def or_else(name: str, default: object):
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    streaming_columns = F.when(
        F.col("records").isNotNull(), F.array(*[F.lit(c) for c in extra])
    ).otherwise(F.array().cast("array<string>"))
    return joined.select(
        "profile",
        F.col("records").isNotNull().alias("streaming_available"),
        or_else("records", 0),
        or_else("years_span", 0),
        streaming_columns.alias("enhanced_columns"),
        F.coalesce("_account", F.lit(False)).alias("account_available"),
        or_else("creation_date", C.UNKNOWN),
        or_else("country", C.UNKNOWN),
        or_else("account_age_years", 0.0),
        F.coalesce("_library", F.lit(False)).alias("library_available"),
        or_else("saved_tracks", 0),
        or_else("saved_albums", 0),
        or_else("followed_artists", 0),
        or_else("followed_shows", 0),
        F.col("search_count").isNotNull().alias("searches_available"),
        or_else("search_count", 0),
        F.col("wrapped_year").isNotNull().alias("wrapped_available"),
        or_else("wrapped_year", C.UNKNOWN),
        V.hours(F.coalesce("_ms", F.lit(0.0))).alias("total_hours"),
        or_else("unique_artists", 0),
    )


def ingest_report(
    files: DataFrame, plays: DataFrame, searches: DataFrame, rejected: DataFrame | None = None
) -> DataFrame:
    """Records of each profile and which kinds of file were read for it.

    Files listed in ``rejected`` (the table of unreadable files) don't count."""
    everyone = files.select("profile").distinct()
    if rejected is not None:
        files = files.join(rejected.select("profile", "file_name").distinct(), ["profile", "file_name"], "left_anti")
    read = (
        files.groupBy("profile").pivot("kind", list(C.KINDS)).count().select(
            "profile",
            *[F.coalesce(F.col(k) > 0, F.lit(False)).alias(f"has_{k}") for k in C.KINDS],
        )
    )
    flags = [c for c in read.columns if c != "profile"]
    present = everyone.join(read, "profile", "left").fillna(False, flags)
    rows = {
        name: table.groupBy("profile").agg(F.count(F.lit(1)).alias(name))
        for name, table in (("streaming_records", plays), ("search_records", searches))
    }
    out = present
    for counted in rows.values():
        out = out.join(counted, "profile", "left")
    return out.fillna(0, list(rows))
