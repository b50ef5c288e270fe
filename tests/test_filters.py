"""Filters, their fall-back, and option searching."""

import pytest

import playledger as P
from playledger import constants as C
from playledger.operators import facets as facet_module
from playledger.operators import filters as filter_module

ROWS = (
    ("p", "A", "x", "2019-01-01", 1.0), ("p", "B", "y", "2020-01-01", 2.0),
    ("q", "A", "z", "2020-01-01", 3.0), ("r", "Only", "w", "2021-01-01", 4.0),
)


def kept(df):
    return sorted((r.profile, r.artistName, r.trackName) for r in df.collect())


def every(rows=ROWS):
    return sorted((p, a, t) for p, a, t, _, _ in rows)


def test_nothing_chosen_keeps_everything(plays_of):
    plays = plays_of(*ROWS)
    assert P.apply_filters(plays, P.Selection()) is plays


def test_filters_combine_and_fall_back_per_profile(plays_of):
    plays = plays_of(*ROWS)
    got = P.apply_filters(plays, P.Selection(years=(2019, 2020), artists=("A",)))
    # "r" has no hit and keeps its row.
    assert kept(got) == [("p", "A", "x"), ("q", "A", "z"), ("r", "Only", "w")]


def test_everything_chosen_equals_nothing_chosen(plays_of):
    got = P.apply_filters(plays_of(*ROWS), P.Selection(years=(2019, 2020, 2021)))
    assert kept(got) == every()


def test_no_hit_at_all_falls_back(plays_of):
    plays = plays_of(*ROWS)
    for by in ((), ("profile",)):
        assert kept(P.apply_filters(plays, P.Selection(songs=("none",)), by=by)) == every()
    # Without profiles the table as a whole decides.
    assert kept(P.apply_filters(plays, P.Selection(songs=("x",)), by=())) == [("p", "A", "x")]


@pytest.mark.parametrize("rows,inline", [(C.BROADCAST_ROWS, 0), (0, 0), (0, C.INLINE_VALUES)])
def test_joins_beyond_the_limits_give_the_same(plays_of, monkeypatch, rows, inline):
    """Long lists by join, broadcast or not."""
    monkeypatch.setattr(C, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(C, "INLINE_VALUES", inline)
    plays = plays_of(*ROWS, *[("s", "S", f"t{i}", "2022-01-01", 1.0) for i in range(300)])
    got = P.apply_filters(plays, P.Selection(years=(2019, 2020), artists=("A",)))
    expected = [("p", "A", "x"), ("q", "A", "z"), ("r", "Only", "w")]
    assert kept(got) == sorted(expected + [("s", "S", f"t{i}") for i in range(300)])


def test_predicates_reach_the_scan(spark, plays_of, tmp_path):
    path = str(tmp_path / "plays")
    plays_of(*ROWS).write.partitionBy("profile").parquet(path)
    plan = P.top_artists(
        P.select_rows(spark.read.parquet(path), P.Selection(years=(2020,)))
    )._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(year,2020)" in plan
    schema = plan[plan.index("ReadSchema"):]
    assert "trackName" not in schema and "albumName" not in schema


def test_top_k_is_cut_before_the_shuffle(plays_of):
    plan = P.top_artists(plays_of(*ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_facets_and_search(plays_of):
    options = P.facets(plays_of(*ROWS, ("p", " Abba ", "x", "2019", 1.0)))
    assert options.where("facet = 'year' AND profile = 'p'").count() == 2
    found = P.search_options(options, "artist", " BB")
    assert [r.value for r in found.collect()] == [" Abba "]
    assert P.search_options(options, "artist").count() == 5
    # Nothing holds "yo" but "Only" shares its letters; "p" and "q" share none.
    suggested = P.suggest_options(options, "artist", "yo").collect()
    assert [(r.profile, r.value) for r in suggested] == [("r", "Only")]
    assert P.suggest_options(options, "artist", "only").where("profile = 'r'").count() == 0


def test_preview_is_the_first_hundred(plays_of):
    options = P.facets(plays_of(*[("p", f"a{i:03d}", "x", "2019", 1.0) for i in range(150)]))
    values = sorted(r.value for r in P.search_options(options, "artist").collect())
    assert values == [f"a{i:03d}" for i in range(100)]


def test_prune_selection(plays_of, monkeypatch):
    options = P.facets(plays_of(*ROWS))
    chosen = P.selection_frame(options, {"artist": ["A", "gone"], "year": [2020, 1999]})
    expected = {("p", "artist", "A"), ("q", "artist", "A"), ("p", "year", "2020"), ("q", "year", "2020")}
    for limit in (C.BROADCAST_ROWS, 0):
        monkeypatch.setattr(C, "BROADCAST_ROWS", limit)
        got = P.prune_selection(options, chosen)
        assert {(r.profile, r.facet, r.value) for r in got.collect()} == expected


def test_modules_read_limits_at_call_time():
    assert filter_module.C is facet_module.C is C
