"""Column functions: every one is a composition of built-in Spark functions."""

from .values import (
    completion, cut, date_key, first_available, first_timestamp, half_even,
    hours, hours_from_minutes, known, loyalty_score, minutes, month_key,
    month_key_parsed, name_sample, play_type, playlist_minutes, safe_numeric,
    span_days, track_label, whole, year_of,
)

__all__ = [
    "completion", "cut", "date_key", "first_available", "first_timestamp",
    "half_even", "hours", "hours_from_minutes", "known", "loyalty_score",
    "minutes", "month_key", "month_key_parsed", "name_sample", "play_type",
    "playlist_minutes", "safe_numeric", "span_days", "track_label", "whole",
    "year_of",
]
