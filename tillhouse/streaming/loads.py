"""Transactions that arrive file by file, loaded as a stream of deltas.

Each micro-batch is one load of :func:`run_delta`, which finds repeats against all that was
loaded before, clean or quarantined: the warehouse itself is the state of the stream, so it
is as large as the disk and never expires. The number of the batch is published in the same
step as its tables. A batch that is tried again after a failure finds its number and does
nothing, so every file counts exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillhouse.operators.quality import Gate
from tillhouse.plans.delta import run_delta
from tillhouse.sources import csv_files
from tillhouse.sources.versions import stored_tables

# A table beside the declared ones: the last batch of each stream.
BATCHES = "state_stream_batches"


def last_batch(spark: SparkSession, root: str, stream: str) -> int:
    """Number of the last loaded batch of a stream, or -1."""
    tables = stored_tables(spark, root)
    if BATCHES not in tables.folders:
        return -1
    found = tables[BATCHES].filter(F.col("stream") == stream).agg(F.max("batch")).first()[0]
    return -1 if found is None else found


def load_batch(spark: SparkSession, root: str, rows: DataFrame, batch: int, stream: str, gate: Gate = Gate()) -> bool:
    """Load one micro-batch; false if it was loaded before."""
    if batch <= last_batch(spark, root, stream):
        return False
    tables = stored_tables(spark, root)
    mine = spark.range(1).select(F.lit(stream).alias("stream"), F.lit(batch).cast("bigint").alias("batch"))
    if BATCHES in tables.folders:  # a row per stream
        mine = mine.unionByName(tables[BATCHES].filter(F.col("stream") != stream))
    run_delta(
        spark, root, csv_files.parsed_transactions(rows), csv_files.FILE_ORDER, gate=gate, beside={BATCHES: mine}
    )
    return True


def follow(
    spark: SparkSession,
    root: str,
    folder: str,
    checkpoint: str,
    stream: str = "transactions",
    files_per_batch: int = 1000,
    gate: Gate = Gate(),
    available_now: bool = True,
) -> StreamingQuery:
    """Load the files of ``folder`` into the warehouse that a refresh has set up.

    Files are taken in the order in which they appear, those of one batch in the order of
    their paths. With ``available_now`` the query ends when all present files are loaded,
    else it goes on. ``checkpoint`` and ``stream`` belong together and to one warehouse.
    """
    rows = csv_files.stream_transactions(spark, folder, files_per_batch)

    def load(batch_rows: DataFrame, batch: int) -> None:
        load_batch(batch_rows.sparkSession, root, batch_rows, batch, stream, gate)

    writer = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).queryName(f"load {stream}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
