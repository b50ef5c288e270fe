"""Shared helpers: tables, written intermediate results, hashed folds, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; below the warehouse where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return base


def stored(df: DataFrame) -> DataFrame:
    """Write once, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove the files behind a frame from `stored` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    hadoop = spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as an empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column,
                    per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most `per_class` training rows of either class.

    Rows are chosen by a hash of the id, so the sample is the same in every run. Labels of
    one id that disagree, null labels and null ids are left out. The chosen ids are at most
    2 * `per_class`, which bounds the broadcast; where rows share ids, those with the smallest
    hashes of id and text stay, so the rows are bounded, too.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where(F.col("label") == F.col("_most")).select("doc_id", "label")
    )
    ranked = [
        known.where(F.col("label") == value)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for value in (0, 1)
    ]
    chosen = ranked[0].unionByName(ranked[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    rows = [
        found.where(F.col("label") == value)
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(per_class)
        for value in (0, 1)
    ]
    return rows[0].unionByName(rows[1])
