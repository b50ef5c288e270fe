"""Edges of the record normalisers, one per record."""

import json

from pyspark.sql import functions as F

from playledger.operators import normalize


def play(**fields):
    return {"ts": "2020-05-06T07:08:09Z", "ms_played": 1000,
            "master_metadata_track_name": "T", **fields}


def run(docs, records, **options):
    text = records if isinstance(records, str) else json.dumps(records)
    frame = docs(("p", "Streaming_History_Audio_0.json", text))
    return [r.asDict() for r in normalize.plays(frame, **options).orderBy("pos").collect()]


def test_timestamps(docs):
    times = [None, "", {"$date": "2021-01-02"}, {"at": "2021"}, "202", "abcd-01", 20190101]
    rows = run(docs, [play(ts=t) for t in times] + [
        {"endTime": "2018-03-04 05:06", "msPlayed": 5}, {"ts": "", "endTime": None}])
    assert [r["ts"] for r in rows] == [
        "", "", "2021-01-02", '{"at":"2021"}', "202", "abcd-01", "20190101",
        "2018-03-04 05:06", None]
    assert [r["year"] for r in rows] == [2023, 2023, 2021, 2023, 2023, 2023, 2019, 2018, 2023]
    assert rows[2]["year_month"] == "2021-01" and rows[7]["date"] == "2018-03-04"
    assert rows[8]["year_month"] is None


def test_milliseconds(docs):
    values = [
        {"ms_played": 0, "msPlayed": 7}, {"ms_played": "12"}, {"ms_played": "x"},
        {"ms_played": None, "msPlayed": 9}, {"ms_played": None, "msPlayed": None},
        {"ms_played": None}, {}, {"ms_played": "12d"}, {"ms_played": True},
        {"ms_played": 30000}, {"ms_played": 30001}, {"ms_played": 1.5}, {"ms_played": [1]},
        {"ms_played": "0", "msPlayed": 5}, {"msPlayed": False}, {"msPlayed": ""},
    ]
    rows = run(docs, [{"trackName": str(i), **v} for i, v in enumerate(values)])
    got = {int(r["trackName"]) if r["trackName"] != "Unknown" else 0: r["msPlayed"] for r in rows}
    assert got == {0: 7.0, 1: 12.0, 3: 9.0, 5: 0.0, 6: 0.0, 8: 1.0, 9: 30000.0, 10: 30001.0,
                   11: 1.5, 13: 0.0, 14: 0.0}
    kinds = {r["msPlayed"]: r["playType"] for r in rows}
    assert kinds[30000.0] == "Partial" and kinds[30001.0] == "Complete"


def test_names(docs):
    rows = run(docs, [
        {"master_metadata_track_name": None, "trackName": "B"},
        {"master_metadata_track_name": "", "trackName": ""},
        {"master_metadata_track_name": "é" * 120},
        {"master_metadata_track_name": 0, "trackName": "0"},
        {"master_metadata_track_name": "0", "trackName": "x"},
        {"master_metadata_track_name": [], "trackName": 7},
        {"master_metadata_album_artist_name": "A", "artistName": "B"},
        {"artistName": "B", "albumName": "C"},
    ])
    assert [r["trackName"] for r in rows] == [
        "B", "Unknown", "é" * 120, "0", "0", "7", "Unknown", "Unknown"]
    assert [r["artistName"] for r in rows][-2:] == ["A", "B"]
    assert rows[-1]["albumName"] == "C"


def test_missing_and_null_attributes(docs):
    records = [{"trackName": "a"}, {"trackName": "b", "platform": None, "skipped": None},
               {"trackName": "c", "platform": "x" * 60, "skipped": True, "conn_country": "y" * 20}]
    rows = run(docs, records)
    assert [r["platform"] for r in rows] == ["Unknown", "Unknown", "x" * 60]
    assert [r["skipped"] for r in rows] == [False, None, True]
    assert [r["completion"] for r in rows] == ["Completed", "Completed", "Skipped"]
    assert rows[2]["conn_country"] == "y" * 20
    strict = run(docs, records, strict_none=True)
    assert [r["platform"] for r in strict] == ["Unknown", "None", "x" * 60]


def test_bad_elements_drop_alone(docs):
    rows = run(docs, [play(), "junk", 3, None, [1], play(master_metadata_track_name="U")])
    assert [(r["pos"], r["trackName"]) for r in rows] == [(0, "T"), (5, "U")]


def test_repeated_key_keeps_last(docs):
    assert run(docs, '[{"trackName":"a","trackName":"b"}]')[0]["trackName"] == "b"


def test_files_that_are_no_list(docs):
    frame = docs(*[
        (str(i), "StreamingHistory0.json", text)
        for i, text in enumerate(["{}", "[]", "[", '[{"trackName":"a"}] x', "[1],[2]", "", "null"])
    ])
    assert normalize.plays(frame).count() == 0
    marked = normalize.plays(frame, keep_unreadable=True)
    assert {r.profile for r in marked.collect()} == {"0", "2", "3", "4", "5", "6"}
    assert marked.where(F.col("pos").isNotNull()).count() == 0


def test_stride(docs):
    rows = run(docs, [play(master_metadata_track_name=str(i)) for i in range(25)],
               max_rows_per_file=10)
    assert [r["pos"] for r in rows] == list(range(0, 25, 2))
    assert len(run(docs, [play()] * 19, max_rows_per_file=10)) == 19


def test_searches(docs):
    frame = docs(("p", "SearchQueries.json", json.dumps([
        {"searchTime": "2021-01-01T00:00", "platform": "p" * 30, "searchQuery": "q",
         "searchInteractionURIs": ["u"]},
        {"searchTime": None, "searchQuery": None}, {"searchTime": 5}, "bad",
        {"searchInteractionURIs": None}, {"searchTime": "20"},
    ])))
    rows = normalize.searches(frame).orderBy("searchQuery", "searchTime").collect()
    assert [(r.searchTime, r.year, r.platform, r.hasInteractions) for r in rows] == [
        (None, 2023, "Unknown", False), ("20", 2023, "Unknown", False),
        ("2021-01-01T00:00", 2021, "p" * 30, True)]
    strict = normalize.searches(frame, strict_none=True)
    assert strict.where("searchQuery = 'None'").count() == 1


PLAYLISTS = {"playlists": [
    {"name": "Mix", "collaborative": True, "lastModifiedDate": "2020-01-01",
     "description": "d" * 300, "items": [
         {"track": {"trackName": " Song\t", "artistName": " Band"}}, {"track": None},
         {"track": {"trackName": "N/A", "artistName": "Band"}},
         {"track": {"trackName": "null", "artistName": "Band"}}, "junk"]},
    {"name": "Mix", "items": [{"track": {"trackName": "Song", "artistName": "Band"}}]},
    {"name": "Empty", "items": []}, {"items": [{"track": {"trackName": "S", "artistName": "B"}}]},
    {"name": "Broken", "items": None}, 5,
]}


def test_playlists(docs):
    frame = docs(("p", "Playlist1.json", json.dumps(PLAYLISTS)), ("q", "Playlist2.json", "[1]"))
    rows = normalize.playlists(frame).orderBy("trackCount").collect()
    assert [(r.playlistName, r.trackCount, r.totalMinutes) for r in rows] == [
        ("Mix", 1, 3.5), ("Mix", 5, 17.5)]
    assert rows[1].collaborative is True and len(rows[1].description) == 300


def test_playlist_items(docs):
    frame = docs(("p", "Playlist1.json", json.dumps(PLAYLISTS)))
    rows = normalize.playlist_items(frame).collect()
    assert sorted((r.playlistName, r.trackName, r.artistName) for r in rows) == [
        ("Mix", "Song", "Band"), ("Mix", "Song", "Band"), ("Mix", "null", "Band"),
        ("Unknown", "S", "B")]


def test_a_record_does_not_depend_on_its_neighbours(docs):
    odd = {"ts": "2020-01-01", "ms_played": 5, "platform": {"b": 1, "a": 2}, "reason_end": 1.50, "trackName": "t"}
    alone, beside = (
        normalize.plays(docs(("p", "StreamingHistory0.json", json.dumps(value)))).first()
        for value in ([odd], [odd, "broken"]))
    assert alone == beside and alone.platform == '{"a":2,"b":1}'


def test_wrapped_time_of_the_other_dialect(docs):
    rows = [{"endTime": {"$date": "2020-05-05T01:02:03Z"}, "msPlayed": 1, "trackName": "t"}]
    row = normalize.plays(docs(("p", "StreamingHistory0.json", json.dumps(rows)))).first()
    assert (row.ts, row.year) == ("2020-05-05T01:02:03Z", 2020)


def test_links_of_any_kind_with_a_length(docs):
    links = ["spot:1", "", {"a": 1}, {}, [], ["x"], None, 3]
    value = json.dumps([{"searchQuery": str(i), "searchInteractionURIs": x} for i, x in enumerate(links)])
    rows = normalize.searches(docs(("p", "SearchQueries.json", value))).collect()
    assert {r.searchQuery: r.hasInteractions for r in rows} == {
        "0": True, "1": False, "2": True, "3": False, "4": False, "5": True}


def test_milliseconds_are_computed_once(spark):
    docs = spark.createDataFrame(
        [("p", "Streaming_History_Audio_1.json", "plays", '[{"ms_played":0.00,"msPlayed":"7"},{"ms_played":"0","msPlayed":5},{"ms_played":"2D"}]')],
        "profile string, file_name string, kind string, value string")
    found = normalize.plays(docs)
    assert [(r["pos"], r["msPlayed"]) for r in found.orderBy("pos").collect()] == [(0, 7.0), (1, 0.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # The condition on them reads a column, and a file's texts and records make one row.
    assert not [line for line in plan if "Filter" in line and "variant" in line.lower()]
    assert sum("Generate" in line for line in plan) == 3


def test_numbers_and_flags_of_every_spelling(docs):
    values = [12, -0.0, 0, 1.5, 1e300, 12345678901234567890, -7, 0.1, True, "0", "7", "", None, [1]]
    rows = run(docs, [{"trackName": str(i), "ms_played": v, "msPlayed": 3} for i, v in enumerate(values)])
    assert {int(r["trackName"]): r["msPlayed"] for r in rows} == {
        0: 12.0, 1: 3.0, 2: 3.0, 3: 1.5, 4: 1e300, 5: 12345678901234567890.0, 6: -7.0, 7: 0.1,
        8: 1.0, 9: 0.0, 10: 7.0, 11: 3.0, 12: 3.0}
    flags = [True, False, None, "true", "no", "x", 1, 0, [], {}]
    rows = run(docs, [play(skipped=v) for v in flags] + [play()])
    assert [r["skipped"] for r in rows] == [True, False, None, True, False, None, True, False, None, None, False]


def test_a_number_under_any_text_key_reads_the_same_beside_other_records(docs):
    # Each key has a pattern of its own that sends such a file the careful way.
    for key in ("platform", "reason_start", "conn_country", "trackName", "albumName"):
        record = {"ms_played": 5, key: 1.50}
        alone, beside = run(docs, [record]), run(docs, [play(), record, play(trackName="x")])
        assert {**alone[0], "pos": 0} == {**beside[1], "pos": 0}
