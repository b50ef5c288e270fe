"""The generic test tables seen as listening history.

Row-level views turn ``lineitem`` and ``events`` into plays, searches and playlist
items. Document views write JSON export files out of table rows, one file per row,
so that the real parsers run over the whole tables without grouping anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import with_derived
from .files import file_kind


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _play_columns() -> list[Column]:
    size, flag = F.col("p_size"), F.col("l_returnflag")
    track = (
        F.when(size == 1, "Unknown").when(size == 2, "N/A").when(size == 3, "")
        .otherwise(F.col("p_name"))
    )
    album = F.when(size == 4, "null").when(size == 5, "UNKNOWN").otherwise(F.col("p_brand"))
    return [
        track.alias("trackName"),
        F.col("s_name").alias("artistName"),
        album.alias("albumName"),
        F.year("l_shipdate").alias("year"),
        (F.col("l_quantity") * 1200).alias("msPlayed"),
        F.col("l_shipdate").cast("string").alias("ts"),
        F.when(flag == "R", True).when(flag == "A", False).alias("skipped"),
    ]


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plays of two profiles."""
    rows = _sold(spark, sf_dir).select(F.col("l_linestatus").alias("profile"), *_play_columns())
    return with_derived(rows)


def customer_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plays of one profile per customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = _sold(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    profile = F.concat(F.lit("c"), F.col("o_custkey"))
    return with_derived(rows.select(profile.alias("profile"), *_play_columns()))


def event_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plays of one profile, all within one month."""
    rows = table(spark, sf_dir, "events").select(
        F.lit("e").alias("profile"),
        F.col("event_type").alias("trackName"),
        F.col("user_id").cast("string").alias("artistName"),
        F.lit("Unknown").alias("albumName"),
        F.year("ts").alias("year"),
        F.rint(F.col("value") * 1000).alias("msPlayed"),
        F.col("ts").cast("string").alias("ts"),
        F.lit(None).cast("boolean").alias("skipped"),
    )
    return with_derived(rows)


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as searches of one profile per user."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id")).alias("profile"),
        F.col("ts").cast("string").alias("searchTime"),
        F.year("ts").alias("year"),
        F.col("event_type").alias("platform"),
        F.col("props").alias("searchQuery"),
        (F.col("value") > 10).alias("hasInteractions"),
    )


def playlist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as playlists, their line items as songs."""
    return _sold(spark, sf_dir).select(
        F.col("l_linestatus").alias("profile"),
        F.concat(F.lit("O"), F.col("l_orderkey")).alias("playlistName"),
        F.col("p_name").alias("trackName"),
        F.col("s_name").alias("artistName"),
    )


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as playlist rows with the estimated minutes."""
    from ..functions import playlist_minutes

    return (
        playlist_items(spark, sf_dir)
        .groupBy("profile", "playlistName")
        .agg(F.count(F.lit(1)).alias("trackCount"))
        .withColumn("totalMinutes", playlist_minutes("trackCount"))
    )


# -- export files written out of table rows ---------------------------------


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt out before the parsing: a table of one row group is one task's read."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _json(**fields: Column) -> Column:
    """One JSON object; NULL fields are written as null."""
    struct = F.struct(*[c.alias(n) for n, c in fields.items()])
    return F.to_json(struct, {"ignoreNullFields": "false"})


def _sparse(**fields: Column) -> Column:
    """One JSON object; NULL fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _docs(rows: DataFrame, profile: Column, file_name: Column, value: Column) -> DataFrame:
    return rows.select(
        profile.alias("profile"), file_name.alias("file_name"),
        file_kind(file_name).alias("kind"), value.alias("value"),
    )


def _words(text: str = "text") -> Column:
    return F.split(F.col(text), " ")


def _objects(make) -> Column:
    """A JSON list with one object per word of a text."""
    return F.to_json(F.transform(_words(), make))


def play_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming-history file per line item: an extended record and an account
    record; files of returned items have a broken element between them, so that
    both ways of parsing are used."""
    day = F.substring(F.col("l_shipdate").cast("string"), 1, 10)
    cols = dict(zip(
        ("track", "artist", "album", "year", "ms", "ts", "skipped"), _play_columns()
    ))
    wrapped = F.concat(F.lit('{"ts":{"$date":"'), day, F.lit('T01:02:03Z"},'))
    plain = F.concat(F.lit('{"ts":"'), day, F.lit('T01:02:03Z",'))
    extended = F.concat(
        F.when(F.col("l_linenumber") == 1, wrapped).otherwise(plain),
        F.substring(_json(
            ms_played=cols["ms"],
            master_metadata_track_name=cols["track"],
            master_metadata_album_artist_name=cols["artist"],
            master_metadata_album_album_name=cols["album"],
            platform=F.col("p_type"), skipped=cols["skipped"], shuffle=F.lit(True),
            reason_end=F.lit(None).cast("string"), conn_country=F.col("l_returnflag"),
        ), 2, 1 << 30),
    )
    account = _json(
        endTime=F.concat(day, F.lit(" 10:00")), artistName=cols["artist"],
        trackName=cols["track"], ms_played=F.lit(0),
        msPlayed=F.col("l_quantity").cast("int").cast("string"),
    )
    return _docs(
        _dealt(_sold(spark, sf_dir)), F.col("l_linestatus"),
        F.concat(F.lit("Streaming_History_Audio_"), F.col("l_orderkey"), F.lit(".json")),
        F.concat(
            F.lit("["), extended,
            F.when(F.col("l_returnflag") == "R", ',"broken", ').otherwise(", "),
            account, F.lit(" ]\n"),
        ),
    )


def word_play_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming-history file per document with a play per word."""
    return _docs(
        table(spark, sf_dir, "documents"),
        F.concat(F.lit("d"), F.col("doc_id")), F.lit("StreamingHistory0.json"),
        _objects(lambda w: F.struct(w.alias("trackName"), F.length(w).alias("msPlayed"))),
    )


def mixed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as JSON files, others as files of plain text."""
    text = F.col("text")
    return _docs(
        table(spark, sf_dir, "documents"),
        F.concat(F.lit("d"), F.col("doc_id")),
        F.when(F.col("source") == "web", "Follow.json").otherwise("Userdata.json"),
        F.when(F.col("lang") == "en", _json(username=text)).otherwise(text),
    )


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search-history file per event: a search and a broken record."""
    links = F.when(F.col("value") > 10, F.array(F.col("event_type"))).otherwise(
        F.array().cast("array<string>")
    )
    return _docs(
        table(spark, sf_dir, "events"),
        F.concat(F.lit("c"), F.col("user_id")), F.lit("SearchQueries.json"),
        F.concat(
            F.lit("["),
            _json(
                searchTime=F.col("ts").cast("string"), platform=F.col("event_type"),
                searchQuery=F.col("props"), searchInteractionURIs=links,
            ),
            F.lit(',{"searchTime":5}]'),
        ),
    )


def playlist_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A playlist file per document: its words as songs, an unnamed and an empty list."""
    song = F.transform(_words(), lambda w: F.when(F.length(w) != 1, F.struct(
        F.struct(
            F.concat(F.lit(" "), w, F.lit("\t")).alias("trackName"),
            F.col("source").alias("artistName"),
        ).alias("track")
    )).otherwise(F.struct(F.lit(None).alias("track"))))
    named = _json(
        name=F.concat(F.col("source"), F.lit("-"), F.col("doc_id")), items=song,
        lastModifiedDate=F.col("lang"), description=F.col("text"),
    )
    value = F.concat(
        F.lit('{"playlists":['), named,
        F.lit(',{"items":[{"track":null}]},{"name":"empty","items":[]},3]}'),
    )
    return _docs(
        _dealt(table(spark, sf_dir, "documents")), F.col("lang"),
        F.concat(F.lit("Playlist"), F.col("doc_id"), F.lit(".json")), value,
    )


def account_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account file per order."""
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    return _docs(
        table(spark, sf_dir, "orders"),
        F.concat(F.lit("o"), F.col("o_orderkey")), F.lit("Userdata.json"),
        _sparse(
            username=F.concat(F.lit("u"), F.col("o_custkey")), country=F.col("o_orderpriority"),
            createdFromFacebook=F.when(F.col("o_orderstatus") == "F", True),
            creationTime=F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(day),
        ),
    )


def customer_docs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Account, library and yearly-summary files per customer."""
    customer = table(spark, sf_dir, "customer")
    profile = F.concat(F.lit("c"), F.col("c_custkey"))
    nations = F.transform(F.sequence(F.lit(0), F.col("c_nationkey")), lambda i: F.struct(i.alias("track")))
    account = _sparse(
        country=F.col("c_mktsegment"), creationTime=F.lit("2020-02-29"),
        username=F.col("c_name"),
    )
    library = _sparse(tracks=nations, artists=F.array(F.col("c_name")))
    wrapped = _sparse(
        yearlyMetrics=F.struct((F.col("c_custkey") * 3600).alias("totalMsListened")),
        topArtists=F.struct(F.col("c_nationkey").alias("numUniqueArtists")),
    )
    rich = F.col("c_acctbal") > 0
    return {
        "account": _docs(customer, profile, F.lit("Userdata.json"), account),
        "library": _docs(customer.where(rich), profile, F.lit("YourLibrary.json"), library),
        "wrapped": _docs(
            customer.where(~rich), profile,
            F.concat(F.lit("Wrapped"), F.col("c_nationkey") + 2000, F.lit(".json")), wrapped,
        ),
        "profiles": customer.select(profile.alias("profile")),
    }


def identifier_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier file per customer."""
    return _docs(
        table(spark, sf_dir, "customer"),
        F.concat(F.lit("c"), F.col("c_custkey")), F.lit("Identifiers.json"),
        _json(
            spotifyId=F.col("c_name"),
            facebookId=F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(""),
            appleId=F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")),
        ),
    )


def wrapped_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yearly-summary file per part."""
    return _docs(
        table(spark, sf_dir, "part"),
        F.concat(F.lit("p"), F.col("p_partkey")),
        F.concat(F.lit("Wrapped"), F.col("p_size") + 2000, F.lit(".json")),
        _sparse(
            yearlyMetrics=F.struct(
                F.rint(F.col("p_retailprice") * 100).cast("bigint").alias("totalMsListened"),
                F.col("p_name").alias("mostListenedDay"),
                F.col("p_size").alias("mostListenedDayMinutes"),
            ),
            topArtists=F.struct(F.col("p_partkey").alias("numUniqueArtists")),
            topTracks=F.struct(F.col("p_size").alias("topTrackPlayCount")),
            musicEvolution=F.struct(F.split(F.col("p_name"), " ").alias("eras")),
        ),
    )


def word_docs(spark: SparkSession, sf_dir: str, file_name: str) -> DataFrame:
    """A summary file of the given name per document, its lists made of the words."""
    first = lambda w: F.substring(w, 1, 1)
    filled = lambda w: F.when(F.length(w) > 0, w)
    if file_name == "YourLibrary.json":
        value = _sparse(
            tracks=F.transform(_words(), lambda w: F.struct(
                filled(w).alias("track"), F.col("source").alias("artist"), w.alias("uri"))),
            albums=F.transform(_words(), lambda w: F.struct(F.repeat(w, 30).alias("album"))),
            artists=F.filter(_words(), lambda w: F.length(w) > 5),
            bannedTracks=F.filter(_words(), lambda w: F.length(w) == 1),
        )
    elif file_name == "Follow.json":
        kind = lambda w: (
            F.when(F.length(w) % 3 == 0, "artist").when(F.length(w) % 3 == 1, "user")
            .otherwise("show")
        )
        value = _sparse(
            following=F.transform(_words(), lambda w: F.struct(kind(w).alias("type"))),
            followers=F.filter(_words(), lambda w: F.length(w) > 4),
        )
    elif file_name == "UserPrompts.json":
        value = _objects(lambda w: F.struct(first(filled(w)).alias("type"), w.alias("text")))
    elif file_name == "PodcastInteractivityVotedPollOption.json":
        value = _objects(lambda w: F.struct(F.when(F.length(w) > 3, w).otherwise("").alias("showName")))
    elif file_name == "UserAddress.json":
        value = _sparse(addresses=F.transform(
            _words(), lambda w: F.struct(F.substring(w, 1, 2).alias("country"))))
    elif file_name == "Purchases.json":
        value = F.concat(
            F.lit("["),
            F.array_join(F.transform(_words(), lambda w: F.when(
                F.length(w) % 2 == 0,
                F.to_json(F.struct(first(w).alias("type"), F.length(w).alias("amount"),
                                   F.col("lang").alias("currency"))),
            ).otherwise(
                F.to_json(F.struct(F.length(w).cast("string").alias("amount"),
                                   F.col("source").alias("currency"))),
            )), ","),
            F.lit(',{"amount":"x"}]'),
        )
    elif file_name == "Payments.json":
        value = _objects(lambda w: F.struct(first(w).alias("method"), w.alias("note")))
    else:
        raise ValueError(f"no such summary file: {file_name}")
    return _docs(
        _dealt(table(spark, sf_dir, "documents")), F.concat(F.lit("d"), F.col("doc_id")),
        F.lit(file_name), value,
    )


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export files ``profile, region, file_name, value, later`` of every nation and every
    thousand events; ``later`` has the plays twice as long.

    A nation has a file of plays and one of playlists for each thousand orders, so no file
    grows with the tables; its account; and a file that can't be read."""
    per_file = 1000
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owner = [F.concat(F.lit("n"), F.col("n_nationkey")).alias("profile"), F.col("r_name").alias("region")]
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(*owner, "o_orderkey", F.expr(f"o_orderkey div {per_file}").alias("block"))
    )
    cols = dict(zip(("track", "artist", "album", "year", "ms", "ts", "skipped"), _play_columns()))
    keys = ("profile", "region", "block")
    # Dealt to their files while the rows are narrow; nothing of a file is dealt out again.
    sold = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .repartition(*keys)
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )

    def record(factor: int) -> Column:
        return _json(
            ts=F.substring(cols["ts"], 1, 10), ms_played=cols["ms"] * factor,
            master_metadata_track_name=cols["track"],
            master_metadata_album_artist_name=cols["artist"],
            master_metadata_album_album_name=cols["album"], skipped=cols["skipped"],
        )

    def listed(records: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.array_sort(records), ","), F.lit("]"))

    song = F.struct(F.struct(
        F.col("p_name").alias("trackName"), F.col("s_name").alias("artistName")).alias("track"))
    lists = sold.groupBy(*keys, "o_orderkey").agg(
        F.collect_list(record(1)).alias("plays"), F.collect_list(record(2)).alias("longer"),
        _json(name=F.concat(F.lit("O"), F.col("o_orderkey")), items=F.array_sort(F.collect_list(song))).alias("list"))
    blocks = lists.groupBy(*keys).agg(
        F.collect_list("plays").alias("plays"), F.collect_list("longer").alias("longer"),
        F.collect_list("list").alias("lists"))
    # Texts are joined where they are read: a row for each kind of file.
    is_list = F.col("is_list")
    texts = F.concat(F.lit('{"playlists":'), listed(F.col("lists")), F.lit("}"))
    name = F.when(is_list, "Playlist").otherwise("Streaming_History_Audio_")
    shared = blocks.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_list")).select(
        "profile", "region", F.concat(name, "block", F.lit(".json")).alias("file_name"),
        F.when(is_list, texts).otherwise(listed(F.flatten("plays"))).alias("value"),
        F.when(is_list, texts).otherwise(listed(F.flatten("longer"))).alias("later"))
    account = nation.select(
        *owner, F.lit("Userdata.json").alias("file_name"), _json(country=F.col("n_name")).alias("value"))
    broken = nation.select(
        *owner, F.lit("Follow.json").alias("file_name"), F.concat(F.lit("{"), "n_name").alias("value"))
    search = _json(
        searchTime=F.col("ts").cast("string"), platform=F.col("event_type"), searchQuery=F.col("props"),
        searchInteractionURIs=F.when(F.col("value") > 10, F.array(F.col("event_type"))).otherwise(
            F.array().cast("array<string>")),
    )
    searched = (
        table(spark, sf_dir, "events").groupBy(F.expr(f"event_id div {per_file}").alias("block"))
        .agg(listed(F.collect_list(search)).alias("value"))
        .select(
            F.concat(F.lit("e"), "block").alias("profile"), F.lit(None).cast("string").alias("region"),
            F.lit("SearchQueries.json").alias("file_name"), "value")
    )
    others = account.unionByName(broken).unionByName(searched)
    return shared.unionByName(others.withColumn("later", F.col("value")))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a file listing of one profile per customer."""
    # One file name for each pair of priority and status.
    names = {
        "1-URGENT": ("Streaming_History_Audio_1.json", "StreamingHistory1.json", "Userdata.json"),
        "2-HIGH": ("YourLibrary.json", "SearchQueries.json", "Wrapped2024.json"),
        "3-MEDIUM": ("Playlist1.json", "Follow.json", "UserPrompts.json"),
        "4-NOT SPECIFIED": (
            "PodcastInteractivityVotedPollOption.json", "UserAddress.json", "Identifiers.json"),
        "5-LOW": ("Purchases.json", "Payments.json", "Marquee.json"),
    }
    name = F.lit("ReadMe.json")
    for priority, (final, opened, partial) in names.items():
        status = F.col("o_orderstatus")
        name = F.when(
            F.col("o_orderpriority") == priority,
            F.when(status == "F", final).when(status == "O", opened).otherwise(partial),
        ).otherwise(name)
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("profile"),
        name.alias("file_name"),
        file_kind(name).alias("kind"),
        F.col("o_orderkey").alias("file_size"),
        F.col("o_orderdate").cast("timestamp").alias("modified"),
        "o_orderpriority",
    )
