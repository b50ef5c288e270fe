"""Aggregates that are kept and merged, against the same from all rows."""

import random

import pytest
from pyspark.sql import functions as F

import playledger as P
from playledger.operators import daybits, option_index, sketches
from playledger.operators.facets import changed_facet_counts, facet_counts


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_loyalty_from_bits_of_runs_that_share_days(plays_of):
    rng = random.Random(4)
    dates = ["2019-12-31", "2020-01-01", "2020-02-29", "2020-03-04", "2020-12-31", "2021-03-05", "2023-02-28"]
    odd = ["", "not a date", "2020-1-5", "2021-02-30", "0001-01-01", None]
    rows = [(rng.choice("pq"), f"A{rng.randrange(9)}", "x", rng.choice(dates), 20.0) for _ in range(400)]
    rows += [("p", f"O{i % 4}", "x", rng.choice(odd + dates), 70.0) for i in range(60)]
    rows += [("p", "Unknown", "x", "2020-01-01", 900.0), ("p", "Never", "x", None, 90.0)]
    rng.shuffle(rows)
    plays = plays_of(*rows)
    bits = daybits.artist_day_bits(plays)
    runs = [daybits.artist_day_bits(plays_of(*rows[i::3])) for i in range(3)]
    merged = runs[0].unionByName(runs[1]).unionByName(runs[2])
    expected = P.artist_loyalty(plays)
    assert same(daybits.loyalty_from_bits(bits), expected)
    assert same(daybits.loyalty_from_bits(merged), expected)
    assert same(daybits.merge_day_bits(merged), bits)
    assert same(daybits.artist_day_bits(P.artist_days(plays)), bits)
    assert bits.count() < P.artist_days(plays).count()
    assert same(daybits.loyalty_from_bits(merged, by=()), P.artist_loyalty(plays, by=()))
    assert daybits.loyalty_from_bits(bits.limit(0)).count() == 0


def test_every_day_of_a_leap_year_has_its_bit(plays_of, spark):
    days = spark.sql("SELECT explode(sequence(date'2020-01-01', date'2020-12-31')) AS d").collect()
    row = daybits.loyalty_from_bits(daybits.artist_day_bits(
        plays_of(*[("p", "A", "x", str(r.d), 1.0) for r in days]))).first()
    assert (row.unique_days, row.span_days, row.first_listen, row.last_listen) == (
        366, 365, "2020-01-01", "2020-12-31")


def test_sketches_of_years_add_up_to_the_whole(spark):
    rows = spark.range(60000).select(
        F.lit("p").alias("profile"), (F.col("id") % 7 + 2000).cast("int").alias("year"),
        F.concat(F.lit("a"), F.col("id") % 9000).alias("artistName"),
        F.concat(F.lit("b"), F.col("id") % 40).alias("albumName"),
        F.concat(F.lit("t"), F.col("id") % 30000).alias("trackName"), F.lit(60000.0).alias("msPlayed"))
    stored = sketches.stat_sketches(rows)
    assert stored.count() == 7
    some = F.col("year") > 2003
    for kept, plays in ((stored, rows), (stored.where(some), rows.where(some)), (stored.unionByName(stored), rows)):
        guess, exact = sketches.quick_stats_estimated(kept).first(), P.quick_stats(plays).first()
        assert guess.years == exact.years
        for name in ("artists", "albums", "tracks"):
            assert guess[name] == pytest.approx(exact[name], rel=5 * sketches.STANDARD_ERROR, abs=1)
    assert sketches.quick_stats_estimated(stored).first().records == 60000
    assert sketches.quick_stats_estimated(stored.limit(0)).count() == 0


def test_counted_facets_follow_random_changes(plays_of):
    rng = random.Random(8)

    def some(n):
        return [("pq"[rng.randrange(2)], f"A{rng.randrange(6)}", f"t{rng.randrange(9)}",
                 f"20{rng.randrange(10, 19)}-01-01", 1.0) for _ in range(n)]

    rows = some(40)
    counts = facet_counts(plays_of(*rows))
    for _ in range(3):
        gone, new = rng.sample(rows, 15), some(4)
        counts = changed_facet_counts(counts, plays_of(*new), plays_of(*gone))
        for row in gone:
            rows.remove(row)
        rows += new
        every = plays_of(*rows)
        assert same(counts, facet_counts(every))
        assert same(counts.drop("n"), P.facets(every).select("profile", "facet", "value"))
        rows += some(12)
        counts = changed_facet_counts(counts, plays_of(*rows[-12:]))
    assert changed_facet_counts(counts, removed=plays_of(*rows)).count() == 0


def test_indexed_search_finds_what_the_scan_finds(spark, tmp_path):
    values = ["Ärger", "  ärgern ", "ab", "a", "", "  ", "Xylophone Solo", "aaa aaaa", "日本語の歌", "50% off", "x y", "É"]
    options = spark.createDataFrame(
        [(p, f, v) for p in "pq" for f in ("song", "artist") for i, v in enumerate(values)
         if (p, f) != ("q", "artist") or i % 2], "profile STRING, facet STRING, value STRING")
    option_index.write_option_index(options, str(tmp_path))
    terms = ["ä", "ÄR", "ärger", "a", "aa", "aaa", "aaaa", "LOPHONE", " solo ", "本語", "語の歌", "%", "x y", "  ", "zzz", "é", "solo"]
    for term in terms:
        for facet in ("song", "artist") if term != "solo" else ("none",):
            found = option_index.search_index(spark, str(tmp_path), facet, term)
            assert same(found, P.search_options(options, facet, term)), term
    plan = option_index.search_index(spark, str(tmp_path), "song", "ärger")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(gram," in plan and "PartitionFilters: [isnotnull(bucket" in plan
