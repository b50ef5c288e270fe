"""Scalar rules shared by the normalisers and the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(*names: ColumnOrName, unknown: Sequence[str] = C.UNKNOWN_NAMES) -> Column:
    """True where every name is a real one; NULL names are not."""
    out = F.lit(True)
    for name in names:
        out = out & ~F.lower(_col(name)).isin(*unknown)
    return out


def cut(text: ColumnOrName, chars: int) -> Column:
    """The first ``chars`` characters."""
    return F.substring(_col(text), 1, chars)


def year_of(text: ColumnOrName) -> Column:
    """Year from the first four characters, or the default year."""
    text = _col(text)
    parsed = F.substring(text, 1, 4).try_cast("int")
    return F.coalesce(F.when(F.length(text) >= 4, parsed), F.lit(C.DEFAULT_YEAR))


def month_key(text: ColumnOrName) -> Column:
    """``yyyy-MM`` by text slice."""
    return F.substring(_col(text), 1, 7)


def month_key_parsed(text: ColumnOrName) -> Column:
    """``yyyy-MM`` by strict parsing: a plain date first, else a date and time."""
    text = _col(text)
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.date_format(F.coalesce(day, F.try_to_timestamp(text)), "yyyy-MM")


def date_key(text: ColumnOrName) -> Column:
    """``yyyy-MM-dd`` by text slice."""
    return F.substring(_col(text), 1, 10)


def minutes(ms: ColumnOrName) -> Column:
    return _col(ms) / F.lit(float(C.MS_PER_MINUTE))


def hours(ms: ColumnOrName) -> Column:
    return _col(ms) / F.lit(float(C.MS_PER_HOUR))


def hours_from_minutes(mins: ColumnOrName) -> Column:
    return _col(mins) / F.lit(60.0)


def play_type(ms: ColumnOrName) -> Column:
    """``Complete`` above half a minute, else ``Partial``."""
    return F.when(_col(ms) > C.COMPLETE_MS, "Complete").otherwise("Partial")


def completion(skipped: ColumnOrName) -> Column:
    """``Skipped`` only where the flag is true; NULL counts as completed."""
    return F.when(_col(skipped), "Skipped").otherwise("Completed")


def track_label(track: ColumnOrName = "trackName", artist: ColumnOrName = "artistName") -> Column:
    return F.concat_ws(" - ", _col(track), _col(artist))


def span_days(first: ColumnOrName, last: ColumnOrName) -> Column:
    """Days between two ``yyyy-MM-dd`` texts; NULL where one is no date."""
    day = "yyyy-MM-dd"
    return F.datediff(F.try_to_date(_col(last), day), F.try_to_date(_col(first), day))


def half_even(number: ColumnOrName, places: int = 1) -> Column:
    """Round half to even, as numeric libraries do (SQL ``round`` is half up)."""
    scale = float(10 ** places)
    return F.rint(_col(number) * scale) / scale


def whole(number: ColumnOrName) -> Column:
    """Nearest whole number, half to even, as BIGINT."""
    return F.rint(_col(number)).cast("bigint")


def loyalty_score(days: ColumnOrName, span: ColumnOrName) -> Column:
    """Percent of days in the span with a play, to one place."""
    return half_even(_col(days) / (_col(span) + 1) * 100)


def playlist_minutes(tracks: ColumnOrName) -> Column:
    """Estimated minutes of a playlist."""
    return _col(tracks) * F.lit(C.MINUTES_PER_TRACK)


def first_timestamp(df: DataFrame, names: Sequence[str] = C.TIMESTAMP_COLUMNS) -> Column | None:
    """The first usable time column of ``df``: per row, the first non-NULL candidate."""
    present = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*present) if present else None


def safe_numeric(text: ColumnOrName) -> Column:
    """First unsigned number found in a text, else 0."""
    # Fixed value: the pattern of a number.
    found = F.regexp_extract(_col(text), r"(\d+\.?\d*)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def safe_number(number: ColumnOrName) -> Column:
    """A numeric column as DOUBLE with 0 for NULL."""
    return F.coalesce(_col(number).cast("double"), F.lit(0.0))


def first_available(*candidates: ColumnOrName, default: object = None, floats: bool = False) -> Column:
    """First candidate that is neither NULL nor (for ``floats``) NaN, else ``default``."""
    tries = [_col(c) for c in candidates]
    if floats:
        tries = [F.nanvl(c, F.lit(None).cast("double")) for c in tries]
    return F.coalesce(*tries, F.lit(default))


def name_sample(names: ColumnOrName, total: ColumnOrName) -> Column:
    """Up to three names in order, with ``...`` when there are more."""
    shown = F.slice(F.array_sort(_col(names)), 1, C.NAMES_SAMPLED)
    more = F.when(_col(total) > C.NAMES_SAMPLED, "...").otherwise("")
    return F.concat(F.concat_ws(", ", shown), more)
