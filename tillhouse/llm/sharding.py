"""Contiguous shards of nearly equal bytes, cut from a global prefix sum.

Method: the rows are range-partitioned by document id; the byte total of each range gives
the offset of the next, so a running sum inside each range is a global prefix sum. The
whole is cut at equal targets. Only DataFrame functions; no step orders all rows in one
task, the one window without a key has a row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.llm.common import parallel, stored

# Rows of one range; its window sorts with spill.
RANGE_ROWS = 1_000_000


def shard_by_bytes(docs: DataFrame, shards: int = 16, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Shard and slot of every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    A row's size is its text's UTF-8 bytes plus 1. The rows stand in order of doc_id
    (nulls first), then checksum and size; a row belongs to the shard in which its middle
    byte falls, so shards are contiguous and differ from the target by less than one
    document. Slots count from 0 inside a shard without gaps.

    A null text counts as empty. Repeated rows are kept and stand next to each other; a
    single id with many rows is spread over ranges. With fewer rows than shards, or a text
    longer than a target, some shards stay empty. An empty table gives an empty result.
    """
    narrow = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    order = ["doc_id", "text_crc32", "size", "_at"]
    ranged = stored(
        narrow.repartitionByRange(parallel(narrow, range_rows), *order).withColumn("_range", F.spark_partition_id())
    )

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_range",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(everything).alias("_total"),
        )
    )
    running = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumns({"_sum": F.sum("size").over(running), "_row": F.row_number().over(running)})
        .join(F.broadcast(offsets), "_range")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("_rows_before") + F.col("_row") - 1).alias("_index"),
            F.expr(f"cast((2 * (_bytes_before + _sum) - size) * {int(shards)} div (2 * _total) as int)").alias("shard"),
        )
    )
    starts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_index") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
