"""One summary row per profile from its single-document files.

Each file is one row, so these are projections with array functions: nothing is
shuffled and nothing is exploded. Lists are read straight to typed values where a VARIANT
would give the same ones, and by one typed cast of a VARIANT elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import json as J
from ..functions import values as V


def _objects(docs: DataFrame, kind: str, *fields: str) -> DataFrame:
    """``profile, file_name, value, d``: the object of each document of a kind."""
    parsed = J.with_document(docs.where(F.col("kind") == kind))
    read = J.once(parsed, d=J.record("doc", fields))
    return read.where(F.col("d").isNotNull()).select("profile", "file_name", "value", "d")


def _read(docs: DataFrame, kind: str, typed: Column, fast, careful) -> DataFrame:
    """``profile`` and the fields of a struct for each document of a kind: ``fast`` of what was read
    straight to typed values, ``careful`` of the VARIANT of all other texts."""
    fields = J.let(typed, lambda t: F.when(t.isNotNull(), fast(t)).otherwise(
        J.let(J.document(), lambda d: F.when(d.isNotNull(), careful(d)))))
    found = docs.where(F.col("kind") == kind).select("profile", F.inline(F.array(F.struct(fields.alias("found")))))
    return found.where(F.col("found").isNotNull()).select("profile", "found.*")


def _read_objects(docs: DataFrame, kind: str, typed: Column, fast, careful, *keys: str) -> DataFrame:
    """Like :func:`_read` for objects; ``careful`` gets the keys' values as VARIANTs."""
    return _read(docs, kind, typed, fast, lambda doc: J.let(
        J.record(doc, keys), lambda d: F.when(d.isNotNull(), careful(d))))


def _lists(docs: DataFrame, kind: str, *keys: str) -> DataFrame:
    """``profile, xs``: the list of each document of a kind, empty if it is no list.

    Elements are structs of the texts under the keys and the number ``amount``."""
    names = [*keys, "amount"]
    kept = ", ".join(f"`{name}`: string" for name in names)

    def alike(x: Column) -> Column:
        # Truth values are numbers, and texts that spell them are not. A number too large has quotes.
        same = ~F.coalesce(x["amount"].isin("true", "false") | x["amount"].startswith('"'), F.lit(False))
        return reduce(Column.__and__, [~J.maybe_spelled(x[key]) for key in keys], same)

    def entry(number: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: F.struct(*[x[key].alias(key) for key in keys], number(x["amount"]).alias("amount"))

    types = dict.fromkeys(keys, "string") | {"amount": "variant"}
    return _read(
        docs, kind, J.typed(f"struct<{kept}>", lambda xs: F.forall(xs, alike), listed=True),
        lambda xs: F.struct(F.transform(xs, entry(J.number_of_text)).alias("xs")),
        lambda doc: F.struct(F.transform(_typed(doc, **types), entry(J.number)).alias("xs")))


def _written(docs: DataFrame, kind: str, key: str) -> DataFrame:
    """``profile, own, texts``: the texts under a key and the JSON texts of the list's elements, for
    each document of a kind; empty if it is no list."""
    maps = J.typed("map<string, string>", _single_keys, listed=True, plain=_only_texts())
    return _read(docs, kind, maps, lambda m: _of_maps(m, key), lambda doc: _of_variants(doc, key))


def _of_maps(maps: Column, key: str) -> Column:
    """``own``, the values of a key, and ``texts``, all elements as JSON."""
    # VARIANTs write keys in order.
    def ordered(m: Column) -> Column:
        return F.when(F.size(m) < 2, m).otherwise(F.map_from_entries(F.sort_array(F.map_entries(m))))

    return F.struct(
        F.coalesce(F.transform(maps, lambda m: m[key]), _none()).alias("own"),
        F.coalesce(F.transform(maps, lambda m: F.to_json(ordered(m))), _none()).alias("texts"))


def _of_variants(list_of: Column, key: str) -> Column:
    """Like :func:`_of_maps`, from a VARIANT list of anything."""
    return F.struct(
        _typed(list_of, **{key: "string"})[key].alias("own"),
        F.coalesce(F.transform(J.items(list_of), lambda x: F.to_json(x)), _none()).alias("texts"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _text(value: Column) -> Column:
    return F.coalesce(J.text(value), F.lit(""))


def _elements(value: Column, **keys: str) -> Column:
    """A VARIANT list as structs of the keys, each of its type; NULL for anything else.

    An element that is no object is NULL, and so is a key that is missing."""
    fields = ", ".join(f"`{key}`: {kind}" for key, kind in keys.items())
    return F.try_variant_get(value, "$", f"array<struct<{fields}>>")


def _typed(value: Column, **keys: str) -> Column:
    """Like :func:`_elements`, empty where there is no list."""
    fields = ", ".join(f"`{key}`: {kind}" for key, kind in keys.items())
    return F.coalesce(_elements(value, **keys), F.array().cast(f"array<struct<{fields}>>"))


def _size(value: Column) -> Column:
    """Length of a list, 0 where there is none."""
    return F.greatest(F.coalesce(F.size(_elements(value, _none="boolean")), F.lit(0)), F.lit(0))


def _distinct(texts: Column, missing: str | None = None) -> Column:
    """Sorted distinct texts; empty and missing ones drop unless named."""
    if missing is not None:
        values = F.transform(F.array_distinct(texts), lambda t: F.coalesce(t, F.lit(missing)))
    else:
        values = F.filter(F.array_distinct(texts), lambda t: t != "")
    return F.array_sort(F.array_distinct(values))


# A key whose value is no text. A text that starts with a colon is found, too.
_NO_TEXT = r'"\s*:\s*[^"\s]'


def _only_texts() -> Column:
    """Whether a file holds texts alone."""
    return ~F.col("value").rlike(_NO_TEXT)


def _only_texts_in_one() -> Column:
    """Whether a file holds texts alone, but for the value after its first colon."""
    return ~F.expr("substr(value, instr(value, ':') + 1)").rlike(_NO_TEXT)


def _single_keys(maps: Column) -> Column:
    """Whether all elements are there, none has a key twice, and keys sort like those of VARIANTs."""
    single = F.forall(maps, lambda m: m.isNotNull() & (
        (F.size(m) < 2) | (F.size(F.array_distinct(F.map_keys(m))) == F.size(m))))
    # VARIANTs sort by code units, in which characters beyond the basic plane stand elsewhere.
    keys = F.array_distinct(F.flatten(F.transform(F.filter(maps, lambda m: F.size(m) > 1), lambda m: F.map_keys(m))))
    return single & ~F.array_join(keys, "").rlike(r"[\x{10000}-\x{10FFFF}]")


def account(docs: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """Account fields and the account's age on ``as_of`` (default: today). Personal data."""
    d = F.col("d")
    texts = [
        "username", "email", "country", "birthdate", "gender", "postalCode", "creationTime",
    ]
    today = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    created = F.try_to_date("creationTime", "yyyy-M-d")
    age = F.datediff(today, created) / F.lit(C.DAYS_PER_YEAR)
    return (
        _objects(docs, "account", *texts, "createdFromFacebook")
        .select(
            "profile", *[_text(d[t]).alias(t) for t in texts],
            J.flag(d["createdFromFacebook"]).alias("createdFromFacebook"),
        )
        .withColumn("account_age_years", F.coalesce(age, F.lit(0.0)))
        .select(*schemas.columns(schemas.ACCOUNT))
    )


def library(docs: DataFrame) -> DataFrame:
    """Seven list sizes and all saved tracks and albums."""
    # The lists counted and the names of their counts.
    counted = {
        "tracks": "saved_tracks_count",
        "albums": "saved_albums_count",
        "artists": "followed_artists_count",
        "shows": "followed_shows_count",
        "episodes": "saved_episodes_count",
        "bannedTracks": "banned_tracks_count",
        "bannedArtists": "banned_artists_count",
    }

    # Lists of which the entries are kept, too.
    kept = {"tracks": ("artist", "album", "track"), "albums": ("artist", "album")}

    def saved(key: str) -> Column:
        def entry(x: Column) -> Column:
            own = [F.coalesce(x[n], F.lit(C.UNKNOWN)).alias(n) for n in kept[key]]
            return F.struct(*own, F.coalesce(x["uri"], F.lit("")).alias("uri"))

        return F.transform(key, entry)

    fields = {key: f"array<struct<{', '.join(f'`{n}`: string' for n in (*names, 'uri'))}>>" for key, names in kept.items()}
    types = dict.fromkeys(counted, "array<string>") | fields

    def alike(key: str) -> Callable[[Column], Column]:
        return lambda x: reduce(Column.__and__, [~J.maybe_spelled(x[n]) for n in (*kept[key], "uri")])

    def fits(own: Column) -> Column:
        return reduce(Column.__and__, [F.coalesce(F.forall(own[key], alike(key)), F.lit(True)) for key in kept])

    def struct(lists: Callable[[str], Column], size: Callable[[str], Column]) -> Column:
        sizes = [size(key).alias(name) for key, name in counted.items() if key not in kept]
        return F.struct(*[lists(key).alias(key) for key in kept], *sizes)

    read = _read_objects(
        docs, "library", J.typed(f"struct<{', '.join(f'`{key}`: {kind}' for key, kind in types.items())}>", fits),
        lambda t: struct(
            lambda key: F.coalesce(t[key], F.array().cast(fields[key])),
            lambda key: F.coalesce(F.size(t[key]), F.lit(0))),
        lambda d: struct(
            lambda key: _typed(d[key], **dict.fromkeys((*kept[key], "uri"), "string")), lambda key: _size(d[key])),
        *counted)
    return read.select(
        "profile",
        *[F.size(key).alias(name) if key in kept else F.col(name) for key, name in counted.items()],
        saved("tracks").alias("saved_tracks"),
        saved("albums").alias("saved_albums"),
    )


def wrapped(docs: DataFrame) -> DataFrame:
    """Yearly summary figures, one row per profile and year (from the file name)."""
    d = F.col("d")
    year = F.replace(F.replace("file_name", F.lit("Wrapped")), F.lit(".json"))

    def figure(section: str, key: str, kind: str) -> Column:
        value = F.try_variant_get(d[section], f"$.{key}", kind)
        return F.coalesce(value, F.lit("" if kind == "string" else 0).cast(kind))

    # Section, key and type of each figure.
    figures = {
        "total_ms_listened": ("yearlyMetrics", "totalMsListened", "double"),
        "most_listened_day": ("yearlyMetrics", "mostListenedDay", "string"),
        "most_listened_day_minutes": ("yearlyMetrics", "mostListenedDayMinutes", "double"),
        "percent_greater_than_users": (
            "yearlyMetrics", "percentGreaterThanWorldwideUsers", "double"),
        "top_artist_fan_percentage": ("topArtists", "topArtistFanPercentage", "double"),
        "top_track_play_count": ("topTracks", "topTrackPlayCount", "bigint"),
        "distinct_tracks_played": ("topTracks", "distinctTracksPlayed", "bigint"),
        "num_unique_artists": ("topArtists", "numUniqueArtists", "bigint"),
    }
    eras = F.size(F.try_variant_get(d["musicEvolution"], "$.eras", "array<variant>"))
    sections = ("yearlyMetrics", "topArtists", "topTracks", "musicEvolution")
    return _objects(docs, "wrapped", *sections).select(
        "profile", year.alias("year"),
        *[figure(*where).alias(name) for name, where in figures.items()],
        F.greatest(F.coalesce(eras, F.lit(0)), F.lit(0)).alias("music_evolution_eras"),
    )


def follow(docs: DataFrame) -> DataFrame:
    """Counts of followers and of followed artists, users and shows."""
    def of_type(name: str) -> Column:
        return F.size(F.filter("types", lambda t: t == name))

    def struct(types: Column, followers: Column) -> Column:
        return F.struct(types.alias("types"), followers.alias("followers_count"))

    kind = "struct<following: array<struct<type: string>>, followers: array<string>>"
    read = _read_objects(
        docs, "follow", J.typed(kind, lambda own: F.coalesce(
            F.forall(own["following"], lambda x: ~J.maybe_spelled(x["type"])), F.lit(True))),
        lambda t: struct(
            F.coalesce(t["following"]["type"], _none()), F.coalesce(F.size(t["followers"]), F.lit(0))),
        lambda d: struct(_typed(d["following"], type="string")["type"], _size(d["followers"])),
        "following", "followers")
    return read.select(
        "profile",
        F.size("types").alias("following_count"),
        "followers_count",
        of_type("artist").alias("following_artists"),
        of_type("user").alias("following_users"),
        of_type("show").alias("following_shows"),
    )


def prompts(docs: DataFrame) -> DataFrame:
    """Number, types and all prompts."""
    return _written(docs, "prompts", "type").select(
        "profile",
        F.size("own").alias("total_prompts"),
        _distinct(F.col("own"), "unknown").alias("prompt_types"),
        F.col("texts").alias("prompts"),
    )


def podcasts(docs: DataFrame) -> DataFrame:
    """Poll votes and the number of shows voted in."""
    return _written(docs, "podcasts", "showName").select(
        "profile",
        F.size("own").alias("total_interactions"),
        F.col("texts").alias("poll_votes"),
        F.size(_distinct(F.col("own"))).alias("shows_interacted"),
    )


def addresses(docs: DataFrame) -> DataFrame:
    """Addresses and their countries. Personal data."""
    maps = J.typed(
        "struct<addresses: array<map<string, string>>>",
        lambda own: F.coalesce(_single_keys(own["addresses"]), F.lit(True)), plain=_only_texts_in_one())
    read = _read_objects(
        docs, "addresses", maps, lambda t: _of_maps(t["addresses"], "country"),
        lambda d: _of_variants(d["addresses"], "country"), "addresses")
    return read.select(
        "profile",
        F.col("texts").alias("addresses"),
        F.size("own").alias("address_count"),
        _distinct(F.col("own")).alias("countries"),
    )


def identifiers(docs: DataFrame) -> DataFrame:
    """Four account ids and whether three of them are set. Personal data."""
    d = F.col("d")
    # Key of each id and the name of its column.
    keys = {
        "spotifyId": "service_id", "facebookId": "facebook_id",
        "appleId": "apple_id", "googleId": "google_id",
    }
    has = {"facebookId": "has_facebook", "appleId": "has_apple", "googleId": "has_google"}
    return _objects(docs, "identifiers", *keys).select(
        "profile",
        *[_text(d[key]).alias(name) for key, name in keys.items()],
        *[J.first_filled(d[key]).isNotNull().alias(name) for key, name in has.items()],
    )


def purchases(docs: DataFrame) -> DataFrame:
    """Number, types, currencies and total amount, currencies added together."""
    xs = F.col("xs")
    amounts = F.transform(xs["amount"], lambda x: F.coalesce(x, F.lit(0.0)))
    return _lists(docs, "purchases", "type", "currency").select(
        "profile",
        F.size(xs).alias("total_purchases"),
        _distinct(xs["type"], "unknown").alias("purchase_types"),
        F.aggregate(amounts, F.lit(0.0), lambda total, x: total + x).alias("total_amount"),
        _distinct(xs["currency"]).alias("currencies"),
    )


def purchases_by_currency(docs: DataFrame) -> DataFrame:
    """Total amount per profile and currency."""
    items = _lists(docs, "purchases", "currency").select(
        "profile", F.explode("xs").alias("x"))
    return (
        items.select("profile", "x.currency", "x.amount")
        .groupBy("profile", "currency")
        .agg(F.count(F.lit(1)).alias("purchases"),
             F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"))
    )


def payments(docs: DataFrame) -> DataFrame:
    """Number, methods and all payments."""
    return _written(docs, "payments", "method").select(
        "profile",
        F.size("own").alias("total_payments"),
        _distinct(F.col("own"), "unknown").alias("payment_methods"),
        F.col("texts").alias("payments"),
    )


def first_prompts(n: int = C.RECENT_PROMPTS) -> Column:
    """The first ``n`` prompts of a row of the prompts table, as shown."""
    return F.slice("prompts", 1, n)


def last_payments(n: int = C.RECENT_PAYMENTS) -> Column:
    """The last ``n`` payments of a row of the payments table, as shown."""
    return F.slice("payments", F.greatest(F.size("payments") - (n - 1), F.lit(1)), F.lit(n))


# Summaries by table name, which is also the kind of file they read.
SUMMARIES: dict[str, Callable[..., DataFrame]] = {
    "account": account,
    "library": library,
    "wrapped": wrapped,
    "follow": follow,
    "prompts": prompts,
    "podcasts": podcasts,
    "addresses": addresses,
    "identifiers": identifiers,
    "purchases": purchases,
    "payments": payments,
}
