"""One summary per file kind."""

import json

import pytest
from pyspark.sql import functions as F

from playledger.functions import json as J
from playledger.operators import summaries as S
from playledger.sources import adapters as A
from playledger.sources import file_kind, rejected_files


def test_routes(spark):
    names = {
        "Streaming_History_Audio_2020.json": "plays", "StreamingHistory0.json": "plays",
        "Userdata.json": "account", "MyUserdata.json": "other", "YourLibrary.json": "library",
        "SearchQueries.json": "searches", "Wrapped2024.json": "wrapped",
        "WrappedPlaylist.json": "wrapped", "Playlist1.json": "playlists", "Follow.json": "follow",
        "UserPrompts.json": "prompts", "PodcastInteractivityVotedPollOption.json": "podcasts",
        "UserAddress.json": "addresses", "Identifiers.json": "identifiers",
        "Purchases.json": "purchases", "Payments.json": "payments", "Inferences.json": "catalogued",
        "Marquee.json": "catalogued", "StreamingHistory_Playlist.json": "plays", "x.json": "other",
    }
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    assert {r[0]: r[1] for r in df.select("name", file_kind("name")).collect()} == names


def test_account(docs):
    def age(created, as_of="2021-01-01"):
        frame = docs(("p", "Userdata.json", json.dumps({"creationTime": created, "email": "e"})))
        row = S.account(frame, as_of).first()
        assert (row.username, row.email, row.createdFromFacebook) == ("", "e", False)
        return row.account_age_years

    assert age("2020-01-01") == 366 / 365.25
    assert age("2020-1-1") == 366 / 365.25
    assert age("2020-02-30") == age("") == age(None) == 0.0
    listed = docs(("p", "Userdata.json", "[1]"))
    assert S.account(listed).count() == 0


def test_library(docs):
    tracks = [{"artist": "a" * 120, "track": str(i)} for i in range(600)]
    text = json.dumps({"tracks": tracks, "albums": [{"uri": "u"}], "shows": [1, 2], "episodes": None})
    row = S.library(docs(("p", "YourLibrary.json", text))).first()
    assert (row.saved_tracks_count, len(row.saved_tracks), row.followed_shows_count) == (600, 600, 2)
    assert (row.saved_episodes_count, row.banned_tracks_count) == (0, 0)
    assert row.saved_tracks[0].artist == "a" * 120 and row.saved_tracks[599].track == "599"
    assert row.saved_albums[0].asDict() == {"artist": "Unknown", "album": "Unknown", "uri": "u"}


def test_wrapped(docs):
    text = json.dumps({"yearlyMetrics": {"totalMsListened": 7200000, "mostListenedDay": "d"},
                       "musicEvolution": {"eras": [1, 2]}})
    frame = docs(("p", "Wrapped2024.json", text), ("p", "Wrapped2023.json", "{}"))
    rows = S.wrapped(frame).orderBy("year").collect()
    assert [(r.year, r.total_ms_listened, r.most_listened_day, r.music_evolution_eras) for r in rows] == [
        ("2023", 0.0, "", 0), ("2024", 7200000.0, "d", 2)]


def test_follow(docs):
    kinds = ["artist", "artist", "user", "show", "other", None]
    text = json.dumps({"following": [{"type": k} for k in kinds], "followers": [1]})
    row = S.follow(docs(("p", "Follow.json", text))).first()
    assert tuple(row)[1:] == (6, 1, 2, 1, 1)
    assert tuple(S.follow(docs(("p", "Follow.json", "{}"))).first())[1:] == (0, 0, 0, 0, 0)


def test_prompts(docs):
    text = json.dumps([{"type": "b"}, {}, {"type": "a"}] + [{"type": "a", "i": i} for i in range(12)])
    row = S.prompts(docs(("p", "UserPrompts.json", text))).first()
    assert (row.total_prompts, row.prompt_types, len(row.prompts)) == (15, ["a", "b", "unknown"], 15)
    assert json.loads(row.prompts[0]) == {"type": "b"}
    other = S.prompts(docs(("p", "UserPrompts.json", "{}"))).first()
    assert (other.total_prompts, other.prompt_types) == (0, [])


def test_podcasts_and_addresses(docs):
    votes = json.dumps([{"showName": "s"}, {"showName": ""}, {"showName": "s"}, {}])
    row = S.podcasts(docs(("p", "PodcastInteractivityVotedPollOption.json", votes))).first()
    assert (row.total_interactions, row.shows_interacted, len(row.poll_votes)) == (4, 1, 4)
    places = json.dumps({"addresses": [{"country": "DE"}, {"country": ""}, {"country": "AT"}]})
    row = S.addresses(docs(("p", "UserAddress.json", places))).first()
    assert (row.address_count, row.countries) == (3, ["AT", "DE"])


def test_identifiers(docs):
    text = json.dumps({"spotifyId": "s", "facebookId": "", "appleId": None, "googleId": "g"})
    row = S.identifiers(docs(("p", "Identifiers.json", text))).first()
    assert tuple(row)[1:] == ("s", "", "", "g", False, False, True)


def test_purchases(docs):
    text = json.dumps([
        {"type": "a", "amount": 1.5, "currency": "EUR"}, {"amount": "2", "currency": "USD"},
        {"type": "a", "amount": "x", "currency": ""}, {"amount": None}, {"amount": "3d"}])
    frame = docs(("p", "Purchases.json", text), ("q", "Purchases.json", "[]"))
    rows = {r.profile: r for r in S.purchases(frame).collect()}
    assert tuple(rows["p"])[1:] == (5, ["a", "unknown"], 3.5, ["EUR", "USD"])
    assert tuple(rows["q"])[1:] == (0, [], 0.0, [])
    by_currency = S.purchases_by_currency(frame).where(F.col("currency") == "USD").first()
    assert (by_currency.purchases, by_currency.total_amount) == (1, 2.0)


def test_payments(docs):
    def last(n):
        text = json.dumps([{"method": "card", "n": i} for i in range(n)])
        row = S.payments(docs(("p", "Payments.json", text))).withColumn(
            "last", S.last_payments()).first()
        assert row.total_payments == n and row.payment_methods == (["card"] if n else [])
        assert [json.loads(p)["n"] for p in row.payments] == list(range(n))
        return [json.loads(p)["n"] for p in row.last]

    assert last(0) == [] and last(3) == [0, 1, 2] and last(8) == [3, 4, 5, 6, 7]


def test_rejected_files(docs):
    frame = docs(("p", "Follow.json", "{}"), ("p", "x.json", "{"), ("q", "y.json", '{"a":1} z'))
    assert {(r.profile, r.file_name) for r in rejected_files(frame).collect()} == {
        ("p", "x.json"), ("q", "y.json")}


def test_lists_of_texts_read_like_any_others(docs):
    """A file of texts alone is written from maps: the same JSON as beside a value of another kind."""
    entries = [
        {"type": "b", "method": "m", "showName": "s\u0001", "country": "\u00e9 \"q\"/", "z": "", "A": "x: y"},
        {}, {"type": "", "a": ":c"},
    ]
    texts = [json.dumps(e, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for e in entries]
    for read, name, column in (
        (S.prompts, "UserPrompts.json", "prompts"), (S.payments, "Payments.json", "payments"),
        (S.podcasts, "PodcastInteractivityVotedPollOption.json", "poll_votes"),
        (S.addresses, "UserAddress.json", "addresses"),
    ):
        def shown(found, ascii_only=False):
            own = {"addresses": found} if column == "addresses" else found
            return [json.loads(t) for t in read(docs(("p", name, json.dumps(own, ensure_ascii=ascii_only)))).first()[column]]

        assert shown(entries) == shown(entries, True) == [json.loads(t) for t in texts]
        mixed = [*entries, {"type": 5}, None, 3, "t", [{"type": "x"}], {"type": None}]
        assert shown(mixed)[:3] == shown(entries) and shown(mixed)[3:] == mixed[3:]
        plain = docs(("p", name, json.dumps({"addresses": [{"b": "1", "a": "2"}]} if column == "addresses"
                                            else [{"b": "1", "a": "2"}])))
        assert read(plain).first()[column] == ['{"a":"2","b":"1"}']
        # The text is written from a map: no VARIANT for each of its elements.
        assert "MapType(StringType,StringType" in read(plain)._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_one_row_group_are_parsed_by_many_tasks(spark, tmp_path):
    rows = [(i, f"some words {i}", "en", "web", 12) for i in range(64)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for made in (A.word_docs(spark, str(tmp_path), "Payments.json"), A.playlist_docs(spark, str(tmp_path))):
        assert made.count() == 64
        assert made.select(F.spark_partition_id()).distinct().count() > 1


ODD = [
    '"a"', '"1989"', '"1.50"', '"-0"', '"true"', '"[x"', '"{}"', '"\\ud83d\\ude00"', "5", "1.50", "-0", "1e3", "1E400",
    "12345678901234567890", "true", "null", '[1,"x"]', '{"b":1,"a":"z"}', "NaN", "'q'", '"12d"', '"Infinity"',
]


def _summary(spark, kind, values):
    rows = [(str(i), "f.json", kind, value) for i, value in enumerate(values)]
    found = S.SUMMARIES[kind](spark.createDataFrame(rows, "profile string, file_name string, kind string, value string"))
    return {int(r["profile"]): r.asDict(True) | {"profile": ""} for r in found.collect()}


@pytest.mark.parametrize(("kind", "key"), [("purchases", "type"), ("purchases", "amount"), ("payments", "method"), ("prompts", "text")])
def test_lists_read_straight_equal_those_of_variants(spark, kind, key):
    own = [f'{{"zz":"y","{key}":{value}}}' for value in ODD]
    # An element that is no object sends the second file to the VARIANT.
    straight = _summary(spark, kind, [f"[{x}]" for x in own])
    careful = _summary(spark, kind, [f"[{x},[]]" for x in own])
    assert straight.keys() == careful.keys() and len(straight) == len(ODD) - 2
    for i, row in straight.items():
        other = careful[i]
        if kind == "purchases":
            assert row["total_amount"] == other["total_amount"]
            assert set(row["purchase_types"]) - {"unknown"} == set(other["purchase_types"]) - {"unknown"}
        else:
            assert row[kind] == other[kind][:1]


def test_plain_files_need_no_variant(spark):
    texts = [
        '[{"a":"x","b":"1989"}]', " [ ]", '[{"a":"x"}] y', '[{"a":"x"}],[{"a":"y"}]', '[{"a":"x"}],[{"a":"y"}]]} y',
        '[{"a":"x"},5]', '[{"a":1.50}]', "[{'a':'x'}]", '{"a":"x"}', "", None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    read = J.typed("struct<`a`: string>", lambda xs: ~F.exists(xs, lambda x: J.maybe_spelled(x["a"])), listed=True)
    assert [r[0] is not None for r in rows.select(read).collect()] == [True, True] + [False] * 9
    kept = spark.createDataFrame([('[{"type":"x","text":"1989"}]',)], "value string")
    maps = J.typed("map<string, string>", S._single_keys, listed=True, plain=S._only_texts())
    assert kept.select(maps).first()[0] == [{"type": "x", "text": "1989"}]


def test_addresses_with_other_values_beside_them(spark):
    found = _summary(spark, "addresses", [
        '{"addresses":[{"country":"SE","b":"x","a":"y"}]}', '{"addresses":[{"country":5}]}', '{"n":1,"addresses":[{"country":"SE"}]}',
        '{"addresses":[{"b":"x","b":"y"}]}', '{"n":5}'])
    assert [found[i]["addresses"] for i in range(5)] == [
        ['{"a":"y","b":"x","country":"SE"}'], ['{"country":5}'], ['{"country":"SE"}'], ['{"b":"y"}'], []]
    assert [found[i]["address_count"] for i in range(5)] == [1, 1, 1, 1, 0]
