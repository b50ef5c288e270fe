"""A training corpus from raw documents, in stages.

Each stage takes the documents that the one before has kept and returns documents; the last
returns packed sequences. `run` writes every stage's result as Parquet to the shared folder
and reads it again, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playledger.llm import packing, pii, quality, setsketch, toxicity
from playledger.llm.common import fold, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts. A null text is scored as an empty one."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.scored(docs.select(*COLUMNS), model).where("quality_ok").select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the lexicon finds no toxic text."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return toxicity.scored(docs.select(*COLUMNS), lexicon).where("NOT toxic_found").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, whatever their ids: the one with the smallest doc_id
    (a null one comes last), then by a hash of the text, then by the other columns.

    Texts without shingles are near nothing and stay unless they equal each other in all columns."""
    own = docs.select(*COLUMNS).withColumn("text_key", pii.key_of_text())
    groups = stored(setsketch.text_components(own))
    # Rows are chosen without their texts, and those that equal each other in all columns are one.
    keys = ["doc_id", "text_key", "lang", "source", "n_chars", "no_text"]
    marked = own.withColumn("no_text", F.col("text").isNull())
    slim = stored(marked.groupBy(*keys).agg((F.count("*") > 1).alias("repeated")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "lang", "source", "n_chars")
    least = slim.join(groups, "text_key").groupBy("component").agg(F.min(order).alias("_least"))
    chosen = stored(least.select("_least.*").drop("no_id"))
    same = slim["text_key"] == chosen["text_key"]
    for c in ("doc_id", "lang", "source", "n_chars"):
        same = same & slim[c].eqNullSafe(chosen[c])
    kept = stored(slim.join(chosen, same, "left_semi").unionByName(slim.join(groups, "text_key", "left_anti")))
    equal = marked["text_key"] == kept["text_key"]
    for c in ("doc_id", "lang", "source", "n_chars", "no_text"):
        equal = equal & marked[c].eqNullSafe(kept[c])
    found = marked.join(kept, equal).select("repeated", *(marked[c] for c in COLUMNS))
    once, more = found.where("NOT repeated"), found.where("repeated")
    return once.select(*COLUMNS).unionByName(more.select(*COLUMNS).distinct())


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is that of the new text."""
    own = docs.select(*COLUMNS)
    found = pii.personal_data(own).where("spans <> ''").groupBy("text_key").agg(F.first("spans").alias("spans"))
    # Spans follow from the text, so rows meet them by it, whatever their ids.
    text = pii.masked(F.col("text"), F.col("spans"))
    marked = own.withColumn("text_key", pii.key_of_text()).join(found, "text_key", "left").withColumn(
        "text", F.when(F.col("spans").isNotNull(), text).otherwise(F.col("text")))
    return marked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicates),
    ("personal_data", mask_personal_data), ("packing", pack),
]

#: SQL can't express the learned filters; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
