"""The pipeline's stages on the smallest tables and on odd documents."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from . import brute
from .test_operators import ODD

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    count = docs.count()
    for name, stage in pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        assert docs.columns == list(pipeline.COLUMNS)
        now = docs.count()
        assert 0 < now <= count and (name != "personal_data" or now == count)
        count = now
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(not brute.base_spans(t) for _, t in rows)
    packed = pipeline.pack(spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in rows}
    once = spark.createDataFrame(packed.collect(), packed.schema)
    assert once.groupBy("doc_id").agg(
        F.sum("length").alias("a"), F.max("doc_tokens").alias("b")).where("a <> b").count() == 0


def test_near_duplicates_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = {i for i, (_, c) in brute.components(rows).items() if i == c}
    found = pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    assert sorted(r.doc_id for r in found) == sorted(expected)


def test_stages_take_odd_and_no_documents(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    for rows in (ODD, []):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, SF_DIR).count() <= 4 * len(rows)
        kept = pipeline.near_duplicates(spark, docs, SF_DIR)
        ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
        assert len(ids) == len(set(ids))


def test_near_duplicates_stage_decides_by_row(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (3, b + " more"), (None, c), (None, c + " more"), (None, a + " more"), (9, None), (9, None), (9, ""), (7, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    found = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, SF_DIR).collect()]
    key = lambda x: (x[0] or 0, x[1] or "", x[1] is None)
    with_c = [x for x in found if x[0] is None]
    assert len(with_c) == 1 and with_c[0][1] in (c, c + " more")
    assert sorted((x for x in found if x[0] is not None), key=key) == sorted(
        [(7, a), (3, b + " more"), (9, None), (9, "")], key=key)


def test_masking_follows_the_text_not_the_id(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    rows = [(1, "to a@b.cd", "en", "s", 9), (1, "to 1.2.3.4", "en", "s", 10), (None, "to a@b.cd", "en", "s", 9), (2, None, "en", "s", None)]
    found = pipeline.mask_personal_data(spark, spark.createDataFrame(rows, schema), SF_DIR).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in found) == [
        (0, "to <EMAIL>", 10), (1, "to <EMAIL>", 10), (1, "to <IP>", 7), (2, "", 0)]
