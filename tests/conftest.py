import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from playledger.session import SETTINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """Raw documents from (profile, file name, text)."""
    from playledger.sources import file_kind

    def make(*rows):
        frame = spark.createDataFrame(list(rows), "profile STRING, file_name STRING, value STRING")
        return frame.select("profile", "file_name", file_kind("file_name").alias("kind"), "value")

    return make


@pytest.fixture
def plays_of(spark):
    """A plays frame from (profile, artist, track, date, minutes)."""
    from pyspark.sql import functions as F

    from playledger.functions import year_of
    from playledger.operators.normalize import with_derived

    def make(*rows):
        frame = spark.createDataFrame(
            list(rows),
            "profile STRING, artistName STRING, trackName STRING, ts STRING, minutes DOUBLE",
        )
        return with_derived(frame.select(
            "profile", "artistName", "trackName", F.lit("Album").alias("albumName"), "ts",
            year_of("ts").alias("year"), (F.col("minutes") * 60000).alias("msPlayed"),
            F.lit(False).alias("skipped"),
        ))

    return make
