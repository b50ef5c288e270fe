"""Building the tables from export files, only for profiles that changed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..operators import normalize
from ..operators.loyalty import artist_days
from ..operators.summaries import SUMMARIES
from ..sources.files import documents, fingerprints, list_files, listing_tasks, rejected_files, scan
from ..sources.tables import (
    bucket_of, commit_runs, current_runs, read_run, stored_rows, write_table,
)
from .rollup import play_rollup


def profile_states(current: DataFrame, previous: DataFrame, force: bool = False) -> DataFrame:
    """``profile, status``: changed (or new), same or gone, by fingerprints."""
    old = previous.select("profile", F.col("fingerprint").alias("_old"))
    both = current.select("profile", "fingerprint").join(old, "profile", "full")
    same = F.lit(False) if force else F.col("fingerprint").eqNullSafe(F.col("_old"))
    status = F.when(F.col("fingerprint").isNull(), "gone").when(same, "same").otherwise("changed")
    return both.select("profile", status.alias("status"))


def changed_profiles(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Profiles whose fingerprint is new, different or gone."""
    return profile_states(current, previous).where("status <> 'same'").select("profile")


def ingest(
    spark: SparkSession,
    src: str,
    dst: str,
    force: bool = False,
    as_of: date | str | None = None,
    strict_none: bool = False,
) -> int:
    """Bring every table under ``dst`` up to date with the files under ``src``.

    Returns the number of changed profiles (new, changed and gone). The file listing is written
    once and everything reads that copy, so a file that changes meanwhile has its old stamp in
    the manifest and the next run takes it up. Only changed profiles' files are opened, however
    many changed; only the buckets of changed profiles are rewritten. Nothing is visible until
    the last step, and a run that stops before is simply repeated.
    """
    with listing_tasks(spark):
        return _ingest(spark, src, dst, force, as_of, strict_none)


def _ingest(
    spark: SparkSession, src: str, dst: str, force: bool, as_of: date | str | None, strict_none: bool
) -> int:
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    held = current_runs(spark, dst)
    # Spark deals files out as if each held megabytes; of the listing a task takes many more.
    scanned = scan(spark, src)
    listed = list_files(spark, src, scanned).coalesce(4 * spark.sparkContext.defaultParallelism)
    files = _stored(listed, f"{dst}/work/{run}/files")
    current = fingerprints(files)
    previous = stored_rows(spark, dst, "manifest", held)
    states = _stored(
        profile_states(current, previous, force).withColumn("bucket", bucket_of("profile")),
        f"{dst}/work/{run}/profiles")
    counts = {r["status"]: r["count"] for r in states.groupBy("status").count().collect()}
    changed = counts.get("changed", 0)
    size = changed + counts.get("gone", 0)
    if size == 0:
        return 0
    touched = [r[0] for r in states.where("status <> 'same'").select("bucket").distinct().collect()]

    every = documents(spark, src, scanned=scanned)
    mine = only_changed(every, states, changed)
    staying = states.where(F.col("bucket").isin(touched) & (F.col("status") == "same")).select("profile")
    old_runs = {bucket: held[bucket] for bucket in touched if bucket in held}

    def put(rows: DataFrame, name: str) -> None:
        kept = stored_rows(spark, dst, name, old_runs).join(staying, "profile", "left_semi")
        write_table(rows, dst, name, run, kept if old_runs else None)

    def docs(*kinds: str) -> DataFrame:
        return mine.where(F.col("kind").isin(*kinds))

    # Files that are no list stay in the plays as rows without a place, so that finding them
    # takes no second parse of the largest files.
    put(normalize.plays(docs("plays"), strict_none=strict_none, keep_unreadable=True), "plays")
    of_changed = states.where("status = 'changed'").select("profile")
    mine_listed = files.join(of_changed, "profile", "left_semi")

    def summarised(name: str) -> None:
        found = docs(name)
        put(SUMMARIES[name](found, as_of) if name == "account" else SUMMARIES[name](found), name)

    # The rollups of whole touched buckets come from the plays just written.
    def rolled(name: str, rollup: Callable[[DataFrame], DataFrame]) -> None:
        plays = read_run(spark, dst, "plays", run)
        write_table(rollup(plays.where(F.col("pos").isNotNull())), dst, name, run)

    def rejected() -> None:
        unread = read_run(spark, dst, "plays", run).where(F.col("pos").isNull()).select(
            "profile", F.col("source_file").alias("file_name"), F.lit("plays").alias("kind"))
        small = rejected_files(docs(*[k for k in C.KINDS if k not in ("plays", "catalogued")]))
        put(small.unionByName(unread.join(of_changed, "profile", "left_semi")), "rejected_files")

    # Never forgotten, so that streamed rows of a file that is gone do not come back.
    def seen() -> None:
        taken = mine_listed.where("kind = 'plays'").select("profile", "file_name")
        known = stored_rows(spark, dst, "seen_files", old_runs)
        write_table(taken.unionByName(known).distinct(), dst, "seen_files", run)

    # The largest first; most tables are small and take a job's fixed time, so some go together.
    _together(
        lambda: put(normalize.playlist_items(docs("wrapped", "playlists")), "playlist_items"),
        lambda: put(normalize.playlists(docs("playlists"), strict_none), "playlists"),
        lambda: put(normalize.searches(docs("searches"), strict_none=strict_none), "searches"),
        rejected,
        lambda: rolled("play_rollup", play_rollup),
        lambda: rolled("artist_days", artist_days),
        *[partial(summarised, name) for name in SUMMARIES],
        lambda: put(mine_listed, "files"),
        seen,
        lambda: put(current.join(of_changed, "profile", "left_semi"), "manifest"),
    )
    commit_runs(spark, dst, held | dict.fromkeys(touched, run), run)
    return size


def _together(*steps: Callable[[], None]) -> None:
    """Run steps that don't depend on each other, some at a time; the first error is raised at the end."""
    with ThreadPoolExecutor(C.TABLES_AT_A_TIME) as pool:
        running = [pool.submit(inheritable_thread_target(step)) for step in steps]
    for step in running:
        step.result()


def only_changed(docs: DataFrame, states: DataFrame, changed: int) -> DataFrame:
    """Documents of changed profiles, from their own folders alone.

    A broadcast list of profiles prunes the folders to open at run time. A list longer than may
    be broadcast is cut into parts by a hash, each of which prunes for itself.
    """
    parts = max(1, -(-changed // C.BROADCAST_ROWS))
    part = F.pmod(F.xxhash64("profile", F.lit(1)), F.lit(parts))
    found = [
        docs.join(
            F.broadcast(states.where((F.col("status") == "changed") & (part == i)).select("profile")),
            "profile", "left_semi")
        for i in range(parts)
    ]
    return reduce(DataFrame.unionByName, found)


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
