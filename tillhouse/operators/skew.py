"""Joins and ordering by a key that may hold a large share of all rows.

Keys with more than ``HEAVY_ROWS`` rows are found first, by a count over the key column
alone, and take a path that spreads their rows; all other keys take the ordinary
shuffle. Which path a row takes never changes the result, only where the work runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# One shuffle group up to this size is left to one task (it sorts with spill).
HEAVY_ROWS = 10_000_000
# A key is heavy only with more than this share of all rows, so there are never more heavy
# keys than this and their list is complete. It matters from 1e13 rows on.
HEAVY_KEYS = 1_000_000
# Hash buckets of the first, cheap count: at least so many, and so many that an average
# bucket holds a sixteenth of what makes a key heavy.
HASH_BUCKETS = 1 << 18
FILL = 16
# A dimension with at most this many rows is broadcast.
BROADCAST_ROWS = 1_000_000


_counted: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def row_count(frame: DataFrame) -> int:
    """Rows of a frame, counted once; on Parquet the count comes from the footers."""
    if frame not in _counted:
        _counted[frame] = frame.count()
    return _counted[frame]


def fits_broadcast(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Size check before a broadcast."""
    return row_count(side) <= max_rows


def buckets_for(total: int, min_rows: int) -> int:
    return max(HASH_BUCKETS, FILL * total // max(1, min_rows))


def _suspects(rows: DataFrame, key: str, min_rows: int, buckets: int) -> DataFrame:
    """Rows (column ``_heavy``) in hash buckets that are large enough for a heavy key."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")
    keyed = rows.select(F.col(key).alias("_heavy"), bucket)
    overfull = keyed.groupBy("_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > min_rows).select("_bucket")
    return keyed.join(F.broadcast(overfull), "_bucket", "left_semi")


def heavy_keys(rows: DataFrame, key: str, min_rows: int = HEAVY_ROWS) -> DataFrame | None:
    """Keys (column ``_heavy``) with more than ``min_rows`` rows, or None when there are none.

    Up to ``min_rows`` rows in all need no further look. Otherwise hash buckets are
    counted first: each task sends a small row per bucket, not one per key. Their number
    follows the rows, so that only keys of overfull buckets are counted one by one, and on
    data without heavy keys the second count has no input. Fewer than ``HEAVY_KEYS`` keys
    can be heavy; they come to the driver.
    """
    total = row_count(rows)
    min_rows = max(min_rows, total // HEAVY_KEYS)
    if total <= min_rows:
        return None
    suspects = _suspects(rows, key, min_rows, buckets_for(total, min_rows))
    found = (
        suspects.groupBy("_heavy")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > min_rows)
        .select("_heavy")
        .collect()
    )
    schema = StructType([StructField("_heavy", rows.schema[key].dataType)])
    return rows.sparkSession.createDataFrame(found, schema) if found else None


def mark_repeats(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    flag: str,
    min_rows: int = HEAVY_ROWS,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """Add ``flag``: true on every row of a key but its first by ``order``.

    An ordinary key is numbered in one window. A heavy key is numbered within each input
    partition, then only the first rows of the partitions compete: no window group is
    larger than one input partition or the number of partitions. Null keys count as one
    key. ``keys_of`` may name a cheaper frame to find heavy keys in.
    """
    by_key = Window.partitionBy(key).orderBy(*order)

    def numbered(some: DataFrame) -> DataFrame:
        return some.withColumn(flag, F.row_number().over(by_key) > 1)

    heavy = heavy_keys(rows if keys_of is None else keys_of, key, min_rows)
    if heavy is None:
        return numbered(rows)

    heavy = F.broadcast(heavy)
    is_heavy = F.col(key).eqNullSafe(F.col("_heavy"))
    by_slice = Window.partitionBy(key, "_slice").orderBy(*order)
    by_round = Window.partitionBy(key, "_round").orderBy(*order, "_slice")
    spread = (
        rows.join(heavy, is_heavy, "left_semi")
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_nth", F.row_number().over(by_slice))
        # Slice winners meet in round -1; the others stay spread and are repeats anyway.
        .withColumn("_round", F.when(F.col("_nth") == 1, F.lit(-1)).otherwise(F.col("_slice")))
        .withColumn(flag, (F.col("_nth") > 1) | (F.row_number().over(by_round) > 1))
        .drop("_slice", "_nth", "_round")
    )
    return numbered(rows.join(heavy, is_heavy, "left_anti")).unionByName(spread)


def sized(side: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """``side``, to be broadcast if it (or ``like``, which has as many rows) passes the size check."""
    return F.broadcast(side) if fits_broadcast(side if like is None else like) else side


# A filter has this many bits per key, in words of 64, and no more words than that: 16 MB. Its
# words are broadcast so many in a row, since in a hash table a word of its own takes nine times
# its bytes, and the driver holds several copies of a table while it makes one.
FILTER_BITS, FILTER_WORDS = 8, 1 << 21
ROW_WORDS = 64


def filtered(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is certainly not in the one column of ``keys``, and the others.

    Each key sets a bit, chosen by its hash, of a filter that is broadcast; more keys than it
    was made for rule out fewer rows.
    """
    words = max(1, min(FILTER_WORDS, row_count(keys) * FILTER_BITS // 64))

    def place(c: Column) -> tuple[Column, Column, Column]:
        """Row of the filter, word in it and bit in that."""
        at = F.pmod(F.xxhash64(c), F.lit(64 * words))
        word, bit = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
        return F.shiftright(at, 12), F.pmod(word, F.lit(ROW_WORDS)).cast("int"), bit

    row, word, bit = place(F.col(keys.columns[0]))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    masks = keys.select(row.alias("_row"), word.alias("_word"), one.alias("_one")).groupBy("_row", "_word").agg(F.bit_or("_one").alias("_mask"))
    by_word = masks.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_mask"))).alias("_by_word"))
    every = F.sequence(F.lit(0), F.lit(ROW_WORDS - 1))
    dense = F.transform(every, lambda i: F.coalesce(F.try_element_at("_by_word", i), F.lit(0).cast("bigint")))
    bits = by_word.select("_row", dense.alias("_masks"))
    row, word, bit = place(rows[key])
    mask = F.coalesce(F.get("_masks", word), F.lit(0).cast("bigint"))
    found = F.call_function("shiftright", mask, bit).bitwiseAND(F.lit(1)) == 1
    tested = rows.join(F.broadcast(bits), row == F.col("_row"), "left")
    return tested.filter(~found).select(rows.columns), tested.filter(found).select(rows.columns)


def lookup(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    how: str,
    small: bool | None = None,
    min_rows: int = HEAVY_ROWS,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """Join rows to a dimension that has one row per ``key`` (``inner`` or ``left``).

    A dimension that passes the size check (or ``small``) is broadcast and the rows stay
    where they are. Any other is met by a shuffle on the key, in which the rows of heavy
    keys are spread over all tasks: they got their dimension row by broadcast before, at
    most ``HEAVY_KEYS`` rows. ``keys_of`` may name a cheaper frame to find heavy keys in.
    """
    if fits_broadcast(dim) if small is None else small:
        return rows.join(F.broadcast(dim), key, how)
    heavy = heavy_keys(rows if keys_of is None else keys_of, key, min_rows)
    if heavy is None:
        return rows.join(dim, key, how)

    payload = [c for c in dim.columns if c != key]
    entries = dim.select(F.col(key).alias("_key"), F.struct(F.lit(True).alias("_found"), *payload).alias("_entry"))
    heavy_entries = entries.join(F.broadcast(heavy), F.col("_key") == F.col("_heavy"), "left_semi")
    heavy_side = heavy.join(F.broadcast(heavy_entries), F.col("_heavy") == F.col("_key"), "left").select(
        "_heavy", F.col("_entry").alias("_heavy_entry"), F.lit(True).alias("_is_heavy")
    )

    # A heavy row may meet a wrong entry in the shuffle; its own one is put in its place.
    spread = F.when(F.col("_is_heavy"), F.concat(F.lit("#"), F.spark_partition_id()))
    entry = F.when(F.col("_is_heavy"), F.col("_heavy_entry")).otherwise(F.col("_entry"))
    joined = (
        rows.join(F.broadcast(heavy_side), F.col(key).eqNullSafe(F.col("_heavy")), "left")
        .withColumn("_spread", spread.otherwise(F.col(key).cast("string")))
        .join(entries.select(F.col("_key").cast("string").alias("_spread"), "_entry"), "_spread", "left")
        .withColumn("_entry", entry)
    )
    if how == "inner":
        joined = joined.filter(F.col("_entry").isNotNull())
    return joined.select(*rows.columns, *(F.col(f"_entry.{c}").alias(c) for c in payload))
