"""The registered queries of this subpackage, by name, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, licenses, neighbours, packing, pieces, pii, quality, setsketch, sharding, spelling, topk, toxicity, whitening,
)
from .common import fold, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"),
        F.col("quality_ok").cast("int").alias("predicted"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled("embedding").alias("vector"))
    return topk.top_inner_products(vectors, F.col("vec_id") % 50 == 0, 5)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.scored(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"),
        F.col("toxic_found").cast("int").alias("predicted"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", whitening.fixed_point("embedding", 64, 1_000_000).alias("x"))
    return whitening.whiten(vectors, 32)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", marked), (-7, 1, "assistant", marked)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality, op2_topk, op3_neighbours, op4_licenses, op5_shards, op6_personal_data, op7_packing,
        op8_toxicity, op9_near_duplicates, op10_pieces, op11_spelling, op12_whitening, op13_chat_format)
}

#: Whole scores of all queries and vectors; all pairs of documents that share a shingle, and
#: what is reachable over their links; texts of conversations, and their length with 32 characters
#: of marks a turn and one more for each escaped control string.
ORACLE: dict[str, str] = {
    "op2_topk": """
        WITH valid AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM valid q JOIN valid c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op9_near_duplicates": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                END AS s
            FROM words
        ), each_one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM each_one a JOIN each_one b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM sets
            UNION
            SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other
        ), least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN least USING (doc_id)""",
    "op13_chat_format": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, role || chr(10) || text || chr(10) AS said, role || chr(0) || text AS both
            FROM turns
        ), marked AS (
            SELECT *, 31 + length(both)
                + len(regexp_extract_all(both, '<\\\\*(\\|im_start\\|>|\\|im_sep\\|>|\\|im_end\\|>|\\|endoftext\\|>|/?s>|</?SYS>>)'))
                + len(regexp_extract_all(both, '\\[\\\\*/?INST\\]')) AS chars
            FROM sized
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id""",
}
