"""Scanning export files laid out as ``<root>/profile=<name>/*.json``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.json import with_document

_EXTENSION = ".json"


def file_kind(file_name: Column | str) -> Column:
    """The kind of record a file holds, by the first matching name rule."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    kind = None
    for label, rule, word in C.FILE_ROUTES:
        match = name.contains(word) if rule == "contains" else name == word
        kind = F.when(match, label) if kind is None else kind.when(match, label)
    return kind.otherwise(C.OTHER_KIND)


@contextmanager
def listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While it holds, folders are listed by a few tasks to a core and not by one each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(int(own), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All files under the root, listed once; only what is selected of them is read."""
    return (
        spark.read.format("binaryFile")
        .schema(
            "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY, "
            "profile STRING"
        )
        .load(root)
    )


def documents(spark: SparkSession, root: str, *kinds: str, scanned: DataFrame | None = None) -> DataFrame:
    """Whole JSON files as text: ``profile, file_name, kind, value``; of an earlier :func:`scan` if given.

    The name conditions use file metadata only, so Spark drops other files from
    the listing and never opens them. Each file is read by one task.
    """
    # A repeated key in one record must not cost the file: the last value counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    name = F.col("_metadata.file_name")
    # As bytes: the reader of whole texts copies the session's Hadoop settings for every file.
    docs = (scan(spark, root) if scanned is None else scanned).where(name.endswith(_EXTENSION))
    if kinds:
        docs = docs.where(file_kind(name).isin(*kinds))
    return docs.select(
        "profile", name.alias("file_name"), file_kind(name).alias("kind"),
        F.col("content").cast("string").alias("value"),
    )


def list_files(spark: SparkSession, root: str, scanned: DataFrame | None = None) -> DataFrame:
    """One row per JSON file, from the file listing alone; no content is read."""
    listing = scan(spark, root) if scanned is None else scanned
    name = F.element_at(F.split("path", "/"), -1)
    return listing.where(F.col("path").endswith(_EXTENSION)).select(
        "profile",
        name.alias("file_name"),
        file_kind(name).alias("kind"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
    )


def list_profiles(files: DataFrame) -> DataFrame:
    """The distinct profiles that own a file."""
    return files.select("profile").distinct()


def fingerprints(files: DataFrame) -> DataFrame:
    """One md5 per profile over the name, time and size of all its files.

    Two sums of numbers cut from the files' md5 stand in for their sorted listing. They
    do not depend on order, so partial sums merge and no task ever holds a profile's
    whole listing.
    """
    stamp = F.concat_ws(":", "file_name", F.unix_micros("modified"), "file_size")

    def number(text: Column) -> Column:
        digits = F.substring(F.md5(text.cast("binary")), 1, 15)
        return F.conv(digits, 16, 10).cast("decimal(38,0)")

    return (
        files.groupBy("profile")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum(number(stamp)).alias("a"),
            F.sum(number(F.concat(F.lit("2"), stamp))).alias("b"),
        )
        .select(
            "profile",
            F.md5(F.concat_ws(":", "files", "a", "b").cast("binary")).alias("fingerprint"),
            "files",
        )
    )


def rejected_files(docs: DataFrame) -> DataFrame:
    """Files that hold no readable JSON document."""
    return (
        with_document(docs).where(F.col("doc").isNull()).select("profile", "file_name", "kind")
    )
