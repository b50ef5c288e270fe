"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # AQE sizes shuffle partitions, splits skewed joins and turns small sides
    # into broadcasts from sizes measured at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Time zone must not move a day or month boundary.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of spoiling the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "playledger", **overrides: str) -> SparkSession:
    """Get or create a session with :data:`SETTINGS`; ``overrides`` use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
