"""Session settings the jobs rely on."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    # Overflow and bad casts raise; without it they would wrap or turn into nulls.
    "spark.sql.ansi.enabled": "true",
    # Dates are plain calendar text; keep every conversion in one zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Above 2,000 shuffle partitions only blocks this much larger than the median
    # keep their exact size; without it adaptive skew handling cannot see them.
    "spark.shuffle.accurateBlockSkewedFactor": "5.0",
}


EXACT = {"spark.sql.ansi.enabled": "true"}
# Jobs broadcast what they have counted. Spark goes by the bytes of compressed files: 7,200,000
# products in 6 MB of them were more than a driver holds.
COUNTED = {"spark.sql.autoBroadcastJoinThreshold": "-1"}

# Shuffled bytes per stored byte of compressed Parquet, roughly.
EXPANSION = 3
# What a task sorts is ten times that: 330 bytes of a raw row in memory were 33 stored. So the
# jobs ask for partitions of this size, and adaptive execution may merge partitions only up to
# this many compressed bytes; ids in a row shrink to a few bytes each.
TASK_BYTES, MERGED_BYTES = 32 << 20, 16 << 20


def shuffle_partitions(stored_bytes: int, target_bytes: int = 256 << 20, most: int = 100_000) -> int:
    """Shuffle width that keeps one partition near ``target_bytes``.

    Stops at ``most``: a wider shuffle costs more in blocks than it saves in spill.
    """
    return max(1, min(most, -(-stored_bytes * EXPANSION // target_bytes)))


def stored_bytes(spark: SparkSession, folder: str | list[str]) -> int:
    """Size of the Parquet files under a folder or several, from the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    return files.load(folder).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Runtime settings for the jobs inside, put back afterwards."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shuffle_width(spark: SparkSession, partitions: int) -> dict[str, str]:
    """Setting for at least this many shuffle partitions; adaptive execution merges small ones."""
    key = "spark.sql.shuffle.partitions"
    return {key: str(max(int(spark.conf.get(key)), partitions))}


def job_width(spark: SparkSession, stored: int) -> dict[str, str]:
    """Settings under which no task of a job over so many stored bytes has to spill."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    merged = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    return shuffle_width(spark, shuffle_partitions(stored, TASK_BYTES)) | {key: str(min(merged, MERGED_BYTES))}


# Open files per task of a write split into two folders. Without it every task sorts its
# rows by folder first.
TWO_WRITERS = {"spark.sql.maxConcurrentOutputFileWriters": "2"}


def build_session(
    app_name: str = "tillhouse",
    master: str | None = None,
    partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with the settings above; ``extra`` takes further ones, dots as ``__``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
