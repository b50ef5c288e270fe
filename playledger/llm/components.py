"""Connected components by alternating stars, as Spark joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang every neighbour (large star: the larger ones) on the smallest of its node."""
    if both_ways:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("least"))
        least = least.select("a", F.least("a", "least").alias("least"))
        moved = near.join(least, "a").where(F.col("b") > F.col("a"))
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        moved = edges.join(least, "a")
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component: its smallest node.

    Self-links and null ends are ignored; repeated links count once. Every round is written
    to the shared folder. The number of rounds grows with the logarithm of the longest path,
    and no node's neighbours are gathered in one row.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = stored(edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct())
    first, last = now, None
    while True:
        following = stored(_star(_star(now, True), False))
        mark = following.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now is not first:
            drop_stored(now)
        now = following
        if mark == last:
            break
        last = mark
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
