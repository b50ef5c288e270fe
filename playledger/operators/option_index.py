"""Finding options by a part of their text without reading all of them.

Every option stands in the postings of each run of three characters of its trimmed lower-case
text, and of each single character and pair, so that shorter terms have postings, too. A search
reads the postings of the term's rarest run only and checks their texts exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = ("profile",)
#: Longest run of characters that has postings; folders that postings are dealt to by a hash.
GRAM, BUCKETS = 3, 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _runs(text: str, length: int) -> Column:
    """Different runs of that many characters in a text column."""
    last = F.length(text) - (length - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(length))))


def option_postings(options: DataFrame, by: Sequence[str] = PROFILE) -> DataFrame:
    """``gram, bucket, facet, value`` and the ``by`` columns of distinct ``options``.

    The empty run stands for all values: terms of blanks alone match everything.
    """
    lowered = options.withColumn("_text", F.lower(F.trim("value")))
    grams = F.concat(F.array(F.lit("")), *[_runs("_text", n) for n in range(1, GRAM + 1)])
    return lowered.select(F.explode(grams).alias("gram"), "facet", *by, "value").select(
        _bucket(F.col("gram")).alias("bucket"), "gram", "facet", *by, "value")


def write_option_index(options: DataFrame, path: str, by: Sequence[str] = PROFILE) -> None:
    """Postings, sorted by run within folders of a hash, and the length of each."""
    (
        option_postings(options, by).hint("rebalance", F.col("bucket"))
        .sortWithinPartitions("bucket", "gram", "facet")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    )
    postings = options.sparkSession.read.parquet(f"{path}/postings")
    (
        postings.groupBy("bucket", "gram", "facet").agg(F.count(F.lit(1)).alias("n"))
        .hint("rebalance", F.col("bucket"))
        .sortWithinPartitions("bucket", "gram", "facet")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lengths")
    )


def search_index(
    spark: SparkSession, path: str, facet: str, term: str, by: Sequence[str] = PROFILE
) -> DataFrame:
    """The rows that ``search_options`` gives for a term, from a written index.

    Only folders and row groups of one run of the term are read. A term without any posting
    gives no rows.
    """
    # Lowered as the options are; one row without a table.
    text = spark.sql("SELECT lower(trim(:term)) AS term", args={"term": term}).first()["term"]
    size = min(GRAM, len(text))
    grams = sorted({text[i:i + size] for i in range(len(text) - size + 1)})
    buckets = spark.createDataFrame([(g,) for g in grams], "gram STRING").select(
        "gram", _bucket(F.col("gram")).alias("bucket"))
    places = {r["gram"]: r["bucket"] for r in buckets.collect()}
    chosen, one = grams[0], F.col("facet") == facet
    if len(grams) > 1:
        lengths = spark.read.parquet(f"{path}/lengths").where(
            one & F.col("bucket").isin(sorted(set(places.values()))) & F.col("gram").isin(grams))
        # At most one row for each run of the term.
        known = {r["gram"]: r["n"] for r in lengths.collect()}
        chosen = min(grams, key=lambda g: (known.get(g, 0), g))
    postings = spark.read.parquet(f"{path}/postings").where(
        (F.col("bucket") == places[chosen]) & (F.col("gram") == chosen) & one)
    found = F.contains(F.lower(F.trim("value")), F.lit(text))
    return postings.where(found).select(*by, "value")
