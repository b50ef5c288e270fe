"""The whole way from table rows to export files, stored tables and reports, three times."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources import adapters as A
from ..sources.exports import write_exports
from ..sources.files import listing_tasks
from ..sources.tables import current_runs, stored_rows
from .ingest import ingest

# What is added up of a table, beside its rows.
_AMOUNTS = {
    "plays": "msPlayed", "play_rollup": "msPlayed", "artist_days": "msPlayed",
    "searches": "CAST(hasInteractions AS INT)", "playlists": "trackCount", "manifest": "files",
}
# Rows of plays without a place stand for files that could not be read.
_READ = {"plays": "pos IS NOT NULL"}


def work_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored_overview(spark: SparkSession, dst: str) -> DataFrame:
    """``table_name, profile, rows, amount`` of every stored table, as of the last commit.

    The frame keeps reading the commit that was the last when it was made. A profile without
    rows in a table has no row here; an amount is 0 where a table has nothing to add up.
    """
    runs = current_runs(spark, dst)
    with listing_tasks(spark):
        found = [
            stored_rows(spark, dst, name, runs).where(_READ.get(name, "true")).groupBy("profile").agg(
                F.count(F.lit(1)).alias("rows"),
                F.sum(F.expr(_AMOUNTS.get(name, "0"))).cast("double").alias("amount"),
            ).select(F.lit(name).alias("table_name"), "profile", "rows", "amount")
            for name in schemas.TABLES
        ]
    return reduce(DataFrame.unionByName, found)


def ingest_cycle(spark: SparkSession, first: DataFrame, changes: DataFrame) -> DataFrame:
    """Ingest ``first``, then ``changes`` to it, then nothing new; the tables after each run.

    Both hold ``profile, file_name, value``; a NULL value removes a file. ``step`` numbers the
    runs, ``changed`` is the number of profiles that a run took up.
    """
    base = work_folder(spark)
    src, dst = f"{base}/exports", f"{base}/tables"
    seen = []
    for step, files in enumerate((first, changes, None), 1):
        if files is not None:
            write_exports(files, src)
        changed = ingest(spark, src, dst)
        # Written at once, so that the driver holds the plan of one overview and not of three.
        overview = stored_overview(spark, dst).select(
            F.lit(step).alias("step"), F.lit(changed).cast("bigint").alias("changed"), "*")
        path = f"{base}/overview/{step}"
        overview.write.parquet(path)
        seen.append(spark.read.schema(overview.schema).parquet(path))
    return reduce(DataFrame.unionByName, seen)


def ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items, orders, nations and events as export files of nations and event blocks.

    Between the runs the profiles of one region change, those of another go, those of a third
    lose their playlists, and those of the last region arrive."""
    files = A.export_files(spark, sf_dir)
    first = files.where(~F.col("region").eqNullSafe("MIDDLE EAST"))
    fewer = (F.col("region") == "EUROPE") & F.col("file_name").startswith("Playlist")
    gone = files.where((F.col("region") == "ASIA") | fewer)
    # Each part apart: no text is made that is not written.
    parts = (
        files.where("region = 'AMERICA'").withColumn("value", F.col("later")),
        files.where("region = 'MIDDLE EAST'"),
        gone.withColumn("value", F.lit(None).cast("string")),
    )
    changes = [part.select("profile", "file_name", "value") for part in parts]
    return ingest_cycle(spark, first, reduce(DataFrame.unionByName, changes))
