"""Plays from files as they land, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize
from ..sources.files import file_kind
from ..sources.tables import bucket_of


def stream_plays(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    files_per_batch: int = 10000,
    once: bool = True,
) -> StreamingQuery:
    """Append the plays of every new streaming-history file to the tables under ``dst``.

    They land beside the plays table, and the plays and their rollups are read with both. A
    file that an ingest takes up, before or after it landed, counts once.

    The file source and the Parquet sink track progress in the checkpoint, so each
    file counts exactly once across restarts. Files are expected to be added and
    never rewritten; for replaced files use the batch ingest, which compares
    fingerprints. ``once`` processes what is there and stops.
    """
    # As in the batch scan: a repeated key in one record must not cost the file.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    name = F.col("_metadata.file_name")
    docs = (
        spark.readStream.schema("value STRING, profile STRING")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .format("text")
        .load(src)
        .where(name.endswith(".json") & (file_kind(name) == "plays"))
        .select("profile", name.alias("file_name"), file_kind(name).alias("kind"), "value")
    )
    writer = (
        normalize.plays(docs).withColumn("bucket", bucket_of("profile"))
        .writeStream.format("parquet")
        .option("path", f"{dst}/plays_landed")
        .option("checkpointLocation", checkpoint)
        .partitionBy("bucket")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
