"""Reports on small hand-written plays."""

import pytest
from pyspark.sql import functions as F

import playledger as P
from playledger import constants as C


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_top_artists_skips_unknown_and_breaks_ties_by_name(plays_of):
    plays = plays_of(
        ("p", "B", "x", "2020-01-01", 5.0), ("p", "A", "x", "2020-01-01", 5.0),
        ("p", "NULL", "x", "2020-01-01", 99.0), ("p", "Unknown", "x", "2020-01-01", 99.0),
        ("p", "C", "x", "2020-01-01", 1.0), ("q", "A", "x", "2020-01-01", 2.0))
    top = P.top_artists(plays, k=2)
    assert set(values(top, "profile", "artistName", "totalMinutes")) == {
        ("p", "A", 5.0), ("p", "B", 5.0), ("q", "A", 2.0)}
    assert values(P.top_artists(plays, k=1, by=()), "artistName") == [("A",)]


def test_favourite_songs_ignore_the_artist(plays_of):
    plays = plays_of(("p", "A", "x", "2020", 1.0), ("p", "B", "x", "2020", 1.0),
                     ("p", "A", "y", "2020", 1.5))
    assert values(P.favourite_songs(plays, k=1), "trackName") == [("x",)]
    assert values(P.top_tracks(plays, k=1), "trackLabel") == [("y - A",)]


def test_by_year(plays_of):
    plays = plays_of(("p", "A", "x", "2019-01-01", 1.0), ("p", "B", "x", "2020-01-01", 2.0),
                     ("p", "A", "x", "2020-01-01", 1.0), ("q", "A", "x", "2018-01-01", 1.0))
    assert len(values(P.top_artists_by_year(plays), "year")) == 4
    assert values(P.top_artists_by_year(plays, k=1, year=2020), "artistName") == [("B",)]
    latest = P.top_artists_by_year(plays, year="latest")
    assert set(values(latest, "profile", "year")) == {("p", 2020), ("q", 2018)}
    with pytest.raises(ValueError):
        P.top_artists_by_year(plays, year="first")


def test_large_k_is_cut_the_same_way(spark):
    df = spark.range(3000).select(
        (F.col("id") % 2).alias("g"), "id", (F.col("id") % 700).alias("v"))
    salted = P.top_k(df, 1200, "v", ["id"], ["g"])
    plain = P.top_k(df, 1200, "v", ["id"], ["g"], rank="n").drop("n")
    assert salted.count() == 2400
    assert salted.exceptAll(plain).count() == 0


@pytest.mark.parametrize("months,grain", [(5, "year"), (6, "month")])
def test_trend_needs_more_than_five_months(plays_of, months, grain):
    plays = plays_of(*[("p", "A", "x", f"2020-{m + 1:02d}-01", 1.0) for m in range(months)])
    rows = P.trend(plays).collect()
    assert {r.grain for r in rows} == {grain}
    assert sum(r.totalMinutes for r in rows) == months


def test_trend_counts_the_empty_month(plays_of):
    dates = [f"2020-{m + 1:02d}-01" for m in range(5)] + [""]
    rows = P.trend(plays_of(*[("p", "A", "x", d, 1.0) for d in dates])).collect()
    assert [r.period for r in rows] == ["", *[d[:7] for d in dates[:5]]]
    assert P.monthly_trend(plays_of(*[("p", "A", "x", d, 1.0) for d in dates]), parsed=True).count() == 5


def test_loyalty(plays_of):
    rows = [("p", "One", "x", "2020-01-01", 60.0), ("p", "Short", "x", "2020-01-01", 59.9)]
    # 5 days of 16 give 31.25, which rounds to the even 31.2.
    rows += [("p", "Even", "x", f"2020-01-{d:02d}", 20.0) for d in (1, 2, 3, 4, 16)]
    rows += [("p", "Bad", "x", "not a date", 70.0), ("p", "Bad", "x", "2020-01-01", 1.0)]
    rows += [("p", "Blank", "x", "", 70.0), ("p", "Blank", "x", "2020-01-01", 1.0)]
    loyal = P.artist_loyalty(plays_of(*rows))
    got = {r.artistName: (r.unique_days, r.span_days, r.loyalty_score) for r in loyal.collect()}
    assert got == {"One": (1, 0, 100.0), "Even": (5, 15, 31.2), "Bad": (2, None, None),
                   "Blank": (1, 0, 100.0)}
    best = P.most_loyal(loyal, k=2)
    assert values(best, "artistName") == [("Blank",), ("One",)]


def test_loyalty_without_dates(plays_of):
    plays = plays_of(("p", "A", "x", "2020", 60.0), ("p", "A", "y", "2020", 1.0)).drop("ts")
    row = P.artist_loyalty(plays).first()
    assert (row.play_count, row.unique_days, row.span_days, row.loyalty_score) == (2, 20, 365, 5.5)


def test_reports_agree_from_rollup(plays_of):
    plays = plays_of(*[("p", f"A{i % 7}", f"t{i % 11}", f"20{10 + i % 9}-0{1 + i % 8}-01", float(i))
                       for i in range(200)])
    roll = P.play_rollup(plays)
    for report in (P.top_artists, P.top_tracks_by_year, P.quick_stats, P.trend, P.facets,
                   P.record_counts, P.year_span, P.monthly_trend):
        a, b = report(plays), report(roll)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, report.__name__
    days = P.artist_days(plays)
    assert P.artist_loyalty(plays).exceptAll(P.artist_loyalty(days)).count() == 0


def test_months_and_years_add_up(plays_of):
    plays = plays_of(*[("p", "A", "x", f"20{10 + i % 9}-0{1 + i % 8}-01", float(i)) for i in range(99)])
    total = P.quick_stats(plays).first().totalHours * 60
    for part in (P.monthly_trend(plays), P.yearly_trend(plays)):
        assert part.agg(F.sum("totalMinutes")).first()[0] == pytest.approx(total)


def test_whole_table_equals_one_profile(plays_of):
    plays = plays_of(*[("p", f"A{i % 30}", f"t{i}", "2020-01-01", float(i)) for i in range(100)])
    for report in (P.top_artists, P.top_tracks, P.quick_stats, P.top_albums_by_year):
        one, alone = report(plays).drop("profile"), report(plays, by=())
        assert one.exceptAll(alone).count() == 0 and one.count() == alone.count()


def test_songs_in_most_playlists(spark):
    items = spark.createDataFrame(
        [("p", name, "Song", "Band") for name in ("d", "c", "b", "a", "a")]
        + [("p", n, "Three", "Band") for n in ("x", "y", "z")]
        + [("p", "a", "Once", "Band"), ("p", "a", "Once", "Band")]
        # Two songs that a glued "track - artist" key would confuse.
        + [("p", "a", "A - B", "C"), ("p", "b", "A", "B - C")],
        "profile STRING, playlistName STRING, trackName STRING, artistName STRING")
    rows = P.songs_in_most_playlists(items).orderBy(F.desc("playlistCount")).collect()
    assert [(r.song, r.playlistCount, r.playlists) for r in rows] == [
        ("Song - Band", 4, "a, b, c..."), ("Three - Band", 3, "x, y, z")]


def test_top_playlists_keeps_same_named_ones(spark):
    lists = spark.createDataFrame(
        [("p", "Mix", 3.5, 1), ("p", "Mix", 7.0, 2), ("p", "Other", 10.5, 3)],
        "profile STRING, playlistName STRING, totalMinutes DOUBLE, trackCount INT")
    top = P.top_playlists(lists, k=2)
    assert values(top, "playlistName", "trackCount") == [("Other", 3), ("Mix", 2)]
    shown = P.top_playlists_display(top)
    assert shown.columns[1:] == ["Playlist Name", "Total Minutes", "Track Count", "Total Hours"]
    # 10.5 minutes round half to even.
    assert {r["Total Minutes"] for r in shown.collect()} == {10, 7}


def test_constants_are_the_published_sizes():
    assert (C.TOP_ARTISTS, C.TOP_TRACKS, C.TOP_PER_YEAR, C.TOP_LOYALTY) == (15, 25, 20, 20)
