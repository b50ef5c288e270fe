"""Export folders to tables, twice and more."""

import importlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

import playledger as P
from playledger.plans import ingest_report, insights_summary
from playledger.sources import (
    documents, fingerprints, list_files, list_profiles, read_dimensions, read_plays, read_table,
)
from playledger.sources.tables import bucket_of, remove_old_runs, stored_rows
from playledger.streaming import stream_plays


def play(track, ts="2020-01-02T03:04:05Z", ms=60000):
    return {"ts": ts, "ms_played": ms, "master_metadata_track_name": track,
            "master_metadata_album_artist_name": "Band"}


def put(root, profile, name, value):
    folder = root / f"profile={profile}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


@pytest.fixture
def src(tmp_path):
    root = tmp_path / "src"
    put(root, "ann", "Streaming_History_Audio_1.json", [play("a"), play("b", "2022-01-01")])
    put(root, "ann", "Streaming_History_Audio_2.json", "[broken")
    put(root, "ann", "Userdata.json", {"country": "DE", "creationTime": "2020-01-01"})
    put(root, "ann", "YourLibrary.json", {"tracks": [{"track": "t"}], "artists": [1, 2]})
    put(root, "ann", "SearchQueries.json", [{"searchQuery": "q"}])
    put(root, "ann", "Wrapped2023.json", {"yearlyMetrics": {"totalMsListened": 3600000}})
    put(root, "ann", "Wrapped2024.json", {"yearlyMetrics": {"totalMsListened": 7200000}})
    put(root, "ann", "Playlist1.json", {"playlists": [
        {"name": n, "items": [{"track": {"trackName": "a", "artistName": "Band"}}]} for n in "xy"]})
    put(root, "ann", "Follow.json", "{bad")
    put(root, "ann", "notes.txt", "no export")
    # A name that looks like a number must stay text.
    put(root, "007", "StreamingHistory0.json", [{"endTime": "2021-01-01 00:00", "trackName": "c",
                                                 "artistName": "Solo", "msPlayed": 5}])
    # A profile without any plays still has its other tables.
    put(root, "bob", "Payments.json", [{"method": "card"}])
    return root


def tracks(spark, dst):
    rows = read_plays(spark, str(dst)).collect()
    return sorted((r.profile, r.trackName) for r in rows)


def test_listing_reads_names_only(spark, src):
    files = list_files(spark, str(src))
    assert {r.profile for r in list_profiles(files).collect()} == {"ann", "007", "bob"}
    assert files.count() == 11
    assert files.where("kind = 'plays'").count() == 3
    docs = documents(spark, str(src), "searches")
    docs.write.format("noop").mode("overwrite").save()
    assert docs.count() == 1


def test_fingerprint_follows_the_files(spark, src):
    def prints():
        return {r.profile: r.fingerprint for r in fingerprints(list_files(spark, str(src))).collect()}

    first = prints()
    assert prints() == first and len(set(first.values())) == 3
    os.utime(src / "profile=bob" / "Payments.json", (1, 1))
    second = prints()
    assert second["ann"] == first["ann"] and second["bob"] != first["bob"]


def test_build_then_change_then_remove(spark, src, tmp_path):
    dst = tmp_path / "dst"
    assert P.ingest(spark, str(src), str(dst)) == 3
    assert tracks(spark, dst) == [("007", "c"), ("ann", "a"), ("ann", "b")]
    assert P.ingest(spark, str(src), str(dst)) == 0

    def rows_of(profile):
        found = stored_rows(spark, str(dst), "plays").withColumn("file", F.input_file_name())
        return {r.file for r in found.where(F.col("profile") == profile).collect()}

    before = rows_of("ann")
    put(src, "007", "StreamingHistory0.json", [{"trackName": "d", "msPlayed": 5}])
    assert P.ingest(spark, str(src), str(dst)) == 1
    assert tracks(spark, dst) == [("007", "d"), ("ann", "a"), ("ann", "b")]
    assert rows_of("ann") == before

    # A file and a whole profile that go away take their rows with them.
    os.remove(src / "profile=ann" / "SearchQueries.json")
    os.remove(src / "profile=007" / "StreamingHistory0.json")
    assert read_table(spark, str(dst), "searches").count() == 1
    assert P.ingest(spark, str(src), str(dst)) == 2
    assert read_table(spark, str(dst), "searches").count() == 0
    assert tracks(spark, dst) == [("ann", "a"), ("ann", "b")]
    assert P.ingest(spark, str(src), str(dst)) == 0
    assert P.ingest(spark, str(src), str(dst), force=True) == 2
    assert tracks(spark, dst) == [("ann", "a"), ("ann", "b")]
    assert remove_old_runs(spark, str(dst)) > 0
    assert os.listdir(dst / "work") == [] and len(list((dst / "commits").glob("commit=*"))) == 1
    assert tracks(spark, dst) == [("ann", "a"), ("ann", "b")]


def test_more_changed_profiles_than_may_be_broadcast(spark, src, tmp_path, monkeypatch):
    from playledger import constants as C

    monkeypatch.setattr(C, "BROADCAST_ROWS", 1)
    dst = tmp_path / "dst"
    assert P.ingest(spark, str(src), str(dst)) == 3
    assert tracks(spark, dst) == [("007", "c"), ("ann", "a"), ("ann", "b")]


@pytest.mark.parametrize("limit", [1, 1000])
def test_only_changed_profiles_files_are_opened(spark, src, tmp_path, monkeypatch, limit):
    from playledger import constants as C
    from playledger.plans.ingest import only_changed, profile_states

    monkeypatch.setattr(C, "BROADCAST_ROWS", limit)
    for i in range(20):
        put(src, f"p{i}", "StreamingHistory0.json", [{"trackName": f"t{i}", "msPlayed": 1}])
    root = str(src)
    now = fingerprints(list_files(spark, root))
    old = now.where(~F.col("profile").isin("p3", "p4"))
    states = spark.createDataFrame(profile_states(now, old).collect(), "profile STRING, status STRING")
    states.write.parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    found = only_changed(documents(spark, root), states, 2).where("kind = 'plays'")
    assert {r.profile for r in found.collect()} == {"p3", "p4"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    text = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search("PartitionFilters: .*dynamicpruning", text)


def test_a_file_that_changes_during_a_run_is_taken_up_next(spark, src, tmp_path, monkeypatch):
    # The package's `ingest` is the function; this is its module.
    job = importlib.import_module("playledger.plans.ingest")
    dst = tmp_path / "dst"
    own = job.normalize.searches

    def meanwhile(*args, **kwargs):
        put(src, "007", "StreamingHistory0.json", [{"trackName": "later", "msPlayed": 5}])
        return own(*args, **kwargs)

    monkeypatch.setattr(job.normalize, "searches", meanwhile)
    job.ingest(spark, str(src), str(dst))
    monkeypatch.setattr(job.normalize, "searches", own)
    assert ("007", "c") in tracks(spark, dst)
    assert P.ingest(spark, str(src), str(dst)) == 1
    assert ("007", "later") in tracks(spark, dst)


def test_files_follow_buckets_not_profiles(spark, src, tmp_path, monkeypatch):
    from playledger import constants as C

    monkeypatch.setattr(C, "BUCKETS", 2)
    for i in range(30):
        put(src, f"p{i}", "StreamingHistory0.json", [{"trackName": f"t{i}", "msPlayed": 1}])
    dst = tmp_path / "dst"
    assert P.ingest(spark, str(src), str(dst)) == 33
    assert len(list((dst / "plays").rglob("*.parquet"))) <= 8
    rollup = read_table(spark, str(dst), "play_rollup")
    assert rollup.count() == 33 and read_table(spark, str(dst), "artist_days").count() == 3
    assert rollup.agg(F.sum("plays")).first()[0] == 33
    assert spark.range(1).select(bucket_of(F.lit("x"))).first()[0] in (0, 1)


def test_tables_and_overviews(spark, src, tmp_path):
    dst = str(tmp_path / "dst")
    assert read_plays(spark, dst).count() == 0
    plays = read_plays(spark, dst, str(src))
    assert plays.count() == 3 and plays.columns[0] == "profile"
    tables = read_dimensions(spark, dst)
    assert tables["payments"].first().payment_methods == ["card"]
    assert {(r.file_name, r.kind) for r in tables["rejected_files"].collect()} == {
        ("Streaming_History_Audio_2.json", "plays"), ("Follow.json", "follow")}

    summary = insights_summary(
        tables["files"].select("profile"), plays, tables["account"], tables["library"],
        tables["searches"], tables["wrapped"])
    rows = {r.profile: r for r in summary.collect()}
    ann, bob = rows["ann"], rows["bob"]
    assert (ann.records, ann.years_span, ann.country, ann.followed_artists) == (2, 3, "DE", 2)
    assert (ann.search_count, ann.wrapped_year, ann.total_hours) == (1, "2024", 2.0)
    assert len(ann.enhanced_columns) == 10
    assert not bob.streaming_available and bob.country == "Unknown" and bob.wrapped_year == "Unknown"

    report = {r.profile: r for r in ingest_report(tables["files"], plays, tables["searches"]).collect()}
    assert report["ann"].streaming_records == 2 and report["ann"].has_wrapped
    assert report["bob"].streaming_records == 0 and not report["bob"].has_plays

    shared = P.songs_in_most_playlists(tables["playlist_items"]).first()
    assert (shared.song, shared.playlists) == ("a - Band", "x, y")
    assert P.top_playlists(tables["playlists"]).count() == 2


def test_stream_counts_each_file_once(spark, src, tmp_path):
    dst, checkpoint = str(tmp_path / "live"), str(tmp_path / "checkpoint")

    def run():
        query = stream_plays(spark, str(src), dst, checkpoint)
        query.awaitTermination(120)
        return sorted(r.trackName for r in read_plays(spark, dst).collect())

    assert run() == ["a", "b", "c"]
    put(src, "bob", "StreamingHistory1.json", [{"trackName": "new", "msPlayed": 1}])
    assert run() == ["a", "b", "c", "new"]
    assert read_plays(spark, dst).where(F.col("profile") == "bob").count() == 1


def test_streamed_and_ingested_files_count_once(spark, src, tmp_path):
    dst, checkpoint = str(tmp_path / "both"), str(tmp_path / "checkpoint")

    def stream():
        stream_plays(spark, str(src), dst, checkpoint).awaitTermination(120)

    def seen():
        names = [r.trackName for r in read_plays(spark, dst).collect()]
        rollup = read_table(spark, dst, "play_rollup")
        for report in (P.top_tracks, P.quick_stats):
            assert {tuple(r) for r in report(rollup).collect()} == {
                tuple(r) for r in report(read_plays(spark, dst)).collect()}
        days = read_table(spark, dst, "artist_days").agg(F.sum("plays")).first()[0] or 0
        assert days == read_plays(spark, dst).where("artistName <> 'Unknown'").count()
        return sorted(names)

    P.ingest(spark, str(src), dst)
    stream()
    assert seen() == ["a", "b", "c"]
    put(src, "bob", "StreamingHistory1.json", [{"trackName": "new", "artistName": "Band", "msPlayed": 60000}])
    stream()
    assert seen() == ["a", "b", "c", "new"]
    stream()
    assert seen() == ["a", "b", "c", "new"]
    assert P.ingest(spark, str(src), dst) == 1
    assert seen() == ["a", "b", "c", "new"]
    # A file that is gone, and a whole profile, do not come back from the stream.
    os.remove(src / "profile=bob" / "StreamingHistory1.json")
    os.remove(src / "profile=007" / "StreamingHistory0.json")
    assert P.ingest(spark, str(src), dst) == 2
    assert seen() == ["a", "b"]


def test_export_sink_writes_replaces_and_removes(spark, tmp_path):
    from playledger.sources import write_exports

    root = str(tmp_path / "exports")

    def write(*rows):
        write_exports(spark.createDataFrame(list(rows), "profile STRING, file_name STRING, value STRING"), root)
        return {(r.profile, r.file_name, r.value) for r in documents(spark, root).collect()}

    odd = "a/b=c %41 \u00fc"
    assert write((odd, "Userdata.json", "{}"), ("p", "Follow.json", "\u00fc")) == {
        (odd, "Userdata.json", "{}"), ("p", "Follow.json", "\u00fc")}
    # The same rows again change nothing; another value replaces, no value removes.
    assert len(write((odd, "Userdata.json", "{}"))) == 2
    assert write((odd, "Userdata.json", "[1]"), ("p", "Follow.json", None), ("q", "Follow.json", None)) == {
        (odd, "Userdata.json", "[1]")}
    with pytest.raises(Exception, match="needs a profile"):
        write((None, "Follow.json", "{}"))


def test_listing_is_stored_in_few_files_however_files_are_dealt(spark, src, tmp_path):
    # Spark's scan makes a task for each file then, as it does for some thirty files by default.
    key, dst = "spark.sql.files.openCostInBytes", tmp_path / "dst"
    own = spark.conf.get(key)
    most = 4 * spark.sparkContext.defaultParallelism
    for i in range(2 * most):
        put(src, f"p{i}", "Userdata.json", {"country": "DE"})
    spark.conf.set(key, "1g")
    try:
        assert P.ingest(spark, str(src), str(dst)) == 2 * most + 3
    finally:
        spark.conf.set(key, own)
    assert len(list((dst / "work").glob("*/files/*.parquet"))) <= most
    assert read_table(spark, str(dst), "files").count() == 2 * most + 11


def test_documents_keep_every_byte(spark, src):
    texts = {"Follow.json": b"\xef\xbb\xbf{}\r\n", "Payments.json": b"[\"\xff\x00\"]\n"}
    for name, content in texts.items():
        put(src, "odd", name, "")
        (src / "profile=odd" / name).write_bytes(content)
    rows = documents(spark, str(src)).where("profile = 'odd'").select("file_name", F.expr("CAST(value AS BINARY)")).collect()
    assert {r[0]: bytes(r[1]) for r in rows} == texts


def test_an_error_in_one_table_commits_nothing(spark, src, tmp_path, monkeypatch):
    job = importlib.import_module("playledger.plans.ingest")

    def broken(*args):
        raise RuntimeError("no table")

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    dst, own = str(tmp_path / "dst"), spark.conf.get(key)
    with monkeypatch.context() as patched:
        patched.setitem(job.SUMMARIES, "payments", broken)
        with pytest.raises(RuntimeError, match="no table"):
            P.ingest(spark, str(src), dst)
    assert spark.conf.get(key) == own
    assert read_plays(spark, dst).count() == 0
    assert P.ingest(spark, str(src), dst) == 3
