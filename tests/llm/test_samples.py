"""The bound of the labelled sample holds for rows, whatever ids they share."""

from __future__ import annotations

from pyspark.sql import functions as F

from playledger.llm.common import labelled_sample


def test_a_hot_id_does_not_exceed_the_bound(spark):
    docs = spark.createDataFrame(
        [(1, f"text {i}") for i in range(2000)] + [(i, f"own {i}") for i in range(2, 200)] + [(None, "x")],
        "doc_id BIGINT, text STRING").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)] + [(None, 1), (4, 1)], "doc_id BIGINT, toxic INT")
    seen = []
    for frame in (docs, docs.repartition(3)):
        rows = labelled_sample(frame, labels, "toxic", F.lit(True), 50).collect()
        assert max(sum(r.label == v for r in rows) for v in (0, 1)) <= 50
        assert all(r.label == r.doc_id % 2 and r.doc_id != 4 for r in rows)
        seen.append(sorted((r.doc_id, r.text) for r in rows))
    assert seen[0] == seen[1] and len(seen[0]) > 50
    # The hot id is label 1 and takes no place of the other class.
    assert sum(i % 2 == 0 for i, _ in seen[0]) == 50
    everything = labelled_sample(docs, labels, "toxic", F.lit(True), 5000).collect()
    assert len(everything) == 2000 + 198 - 1
