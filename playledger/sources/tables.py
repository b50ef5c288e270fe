"""Parquet tables in buckets of profiles, replaced one bucket at a time.

A profile belongs to the bucket that a hash of its name gives, so the number of files depends
on buckets and data and not on profiles. A run writes the touched buckets of a table to
``<table>/run=<run>/bucket=<n>`` and names the run of every bucket in ``commits`` when all
tables are written. Readers follow the last commit: a run that stops half-way changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas


def bucket_of(profile: Column | str) -> Column:
    return F.pmod(F.xxhash64(profile), F.lit(C.BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_runs(spark: SparkSession, dst: str) -> dict[int, str]:
    """The run that holds each bucket; at most ``BUCKETS`` entries."""
    commits = _read(spark, f"{dst}/commits", "bucket INT, held STRING, commit STRING")
    last = commits.agg(F.max("commit")).first()[0] if commits is not None else None
    if last is None:
        return {}
    return {r["bucket"]: r["held"] for r in commits.where(F.col("commit") == last).collect()}


def commit_runs(spark: SparkSession, dst: str, runs: dict[int, str], run: str) -> None:
    """Make a run's buckets the ones that readers see."""
    rows = spark.createDataFrame(sorted(runs.items()), "bucket INT, held STRING").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{dst}/commits/commit={run}")


def write_table(rows: DataFrame, dst: str, name: str, run: str, kept: DataFrame | None = None) -> None:
    """Write a run's buckets of a table: new rows, and ``kept`` rows of other profiles.

    The rebalance gives files of a sensible size: small buckets share a task, a hot one is
    split over many. Rows are sorted by profile, so statistics skip most of a bucket's files.
    """
    live = rows.select(*schemas.columns(schemas.TABLES[name]))
    if kept is not None:
        live = live.unionByName(kept.select(*live.columns))
    (
        live.withColumn("bucket", bucket_of("profile"))
        .hint("rebalance", F.col("bucket"))
        .sortWithinPartitions("bucket", "profile")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{dst}/{name}/run={run}")
    )


def read_run(spark: SparkSession, dst: str, name: str, run: str) -> DataFrame:
    """What one run has written of a table, committed or not."""
    schema = schemas.TABLES[name]
    found = _read(spark, f"{dst}/{name}/run={run}", f"{schema}, bucket INT")
    return spark.createDataFrame([], schema) if found is None else found.drop("bucket")


def stored_rows(
    spark: SparkSession, dst: str, name: str, runs: dict[int, str] | None = None
) -> DataFrame:
    """All rows of a table's live buckets; of plays also a row for each unreadable file."""
    schema = schemas.TABLES[name]
    runs = current_runs(spark, dst) if runs is None else runs
    found = _read(spark, f"{dst}/{name}", f"{schema}, run STRING, bucket INT") if runs else None
    if found is None:
        return spark.createDataFrame([], schema)
    # A condition on folder names alone: other folders are never listed as files to read.
    live = F.concat_ws("/", "run", "bucket").isin([f"{run}/{bucket}" for bucket, run in runs.items()])
    return found.where(live).select(*schemas.columns(schema))


def landed_plays(spark: SparkSession, dst: str, runs: dict[int, str]) -> DataFrame | None:
    """Streamed plays of files that no ingest has taken up; None where nothing was streamed.

    A file that an ingest has seen belongs to the ingest for good: its streamed rows stay out
    also after it is changed or removed.
    """
    landed = _read(spark, f"{dst}/plays_landed", f"{schemas.PLAYS}, bucket INT")
    if landed is None:
        return None
    seen = stored_rows(spark, dst, "seen_files", runs).withColumnRenamed("file_name", "source_file")
    return landed.drop("bucket").join(seen, ["profile", "source_file"], "left_anti")


def read_table(spark: SparkSession, dst: str, name: str) -> DataFrame:
    """A table's rows; an empty frame of the same schema when it does not exist.

    Plays include those that a stream has landed beside the table, and so do the two rollups:
    they can hold a key twice then, stored and landed, which every report adds up. A file that
    was both landed and ingested counts once, whichever came first.
    """
    from ..operators.loyalty import artist_days
    from ..plans.rollup import play_rollup

    runs = current_runs(spark, dst)
    rows = stored_rows(spark, dst, name, runs)
    if name == "plays":
        rows = rows.where(F.col("pos").isNotNull())
    folded = {"plays": lambda df: df, "play_rollup": play_rollup, "artist_days": artist_days}
    landed = landed_plays(spark, dst, runs) if name in folded else None
    if landed is None:
        return rows
    return rows.unionByName(folded[name](landed).select(*rows.columns))


def read_plays(spark: SparkSession, dst: str, src: str | None = None) -> DataFrame:
    """The plays table; built from ``src`` first when it does not exist yet."""
    if src is not None and not current_runs(spark, dst):
        from ..plans.ingest import ingest

        ingest(spark, src, dst)
    return read_table(spark, dst, "plays")


def read_dimensions(spark: SparkSession, dst: str) -> dict[str, DataFrame]:
    """Every table besides the plays and their rollups, by name; missing ones are empty."""
    others = ("plays", "manifest", "seen_files", "play_rollup", "artist_days")
    return {name: read_table(spark, dst, name) for name in schemas.TABLES if name not in others}


def remove_old_runs(spark: SparkSession, dst: str) -> int:
    """Delete the folders that no reader of the last commit needs; the number of buckets' folders.

    Working copies of runs and all commits but the last go, too. Only for times when no other
    run or older reader is at work."""
    runs = current_runs(spark, dst)
    if not runs:
        return 0
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(dst).getFileSystem(spark._jsc.hadoopConfiguration())

    def folders(pattern: str) -> list:
        return [found.getPath() for found in files.globStatus(path(f"{dst}/{pattern}")) or []]

    gone = 0
    for name in schemas.TABLES:
        for own in folders(f"{name}/run=*/bucket=*"):
            bucket = int(own.getName().split("=")[1])
            if runs.get(bucket) != own.getParent().getName().split("=", 1)[1]:
                gone += bool(files.delete(own, True))
    # Names start with the time of the run, so the last commit is the largest.
    for own in [*sorted(folders("commits/commit=*"), key=lambda p: p.getName())[:-1], *folders("work/*")]:
        files.delete(own, True)
    return gone
