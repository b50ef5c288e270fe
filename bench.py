"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs
twice, the first time to warm up; the better run counts. Results go to the no-op
sink, so every output column is computed and nothing is collected. Other queries can
be named on the command line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from playledger.plans.catalog import QUERIES  # noqa: E402
from playledger.session import SETTINGS  # noqa: E402

HEADLINE = (
    "top_artists", "quick_stats", "quick_stats_from_rollup", "top_tracks", "top_albums",
    "top_artists_by_year", "top_tracks_by_year", "trend_auto_plays", "artist_loyalty",
    "filter_all", "filter_fallback", "facets", "songs_in_most_playlists", "top_playlists",
    "searches_normalized", "insights_summary", "ingest_report", "normalize_roundtrip",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        # A table of one small file still gives every core a split to read.
        .config("spark.sql.files.maxPartitionBytes", "4m")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times = {}
    for name in chosen:
        times[name] = round(min(run(name), run(name)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
