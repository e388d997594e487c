"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tillhouse.operators.skew import fits_broadcast
from tillhouse.sources.tables import materialize, scratch_folder

# Most rows of a table of ids and numbers that is sent to every executor; counted before.
SMALL_ROWS = 500_000
# And most entries, of a few numbers each, where rows hold lists.
SMALL_ENTRIES = 1_000_000

# Name under which a whole input row travels beside computed columns, so that extra
# columns of the input never clash with ours.
ROW = "_row"


# Bytes of one batch handed to a Python worker, about; it is held there and by the JVM.
ARROW_BYTES = 4 << 20


def stored(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder of the cluster and read back: lineage ends here."""
    return materialize(rows, scratch_folder(rows.sparkSession))


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, after the session was told to hand texts to Python in small batches.

    The setting stays, since frames run after the function that made them has returned.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return rows


def types(rows: DataFrame, *names: str, **more: str) -> StructType:
    """Schema of columns of ``rows`` and of further ones, by name and simple type."""
    kept = [StructField(n, rows.schema[n].dataType) for n in names]
    return StructType([*kept, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in more.items())).fields])


def small(side: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A join side with a broadcast hint if its count allows, else as it is."""
    return F.broadcast(side) if fits_broadcast(side, rows) else side


def small_lists(side: DataFrame, lists: str, entries: int = SMALL_ENTRIES) -> DataFrame:
    """The same for rows with a list each: what counts is the entries of all lists."""
    total = side.agg(F.sum(F.size(lists) + 1)).first()[0] or 0
    return F.broadcast(side) if total <= entries else side


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(ROW)


def parallel(rows: DataFrame, rows_per_task: int) -> int:
    """Tasks for a counted table: at least the session's shuffle width."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_task))


def slices(
    batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 19, most_rows: int = 1 << 15
) -> Iterator[pa.RecordBatch]:
    """Parts of a batch holding about ``most_bytes`` of one text column; every row once."""
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.frombuffer(texts.buffers()[1], _offset_type(texts))[texts.offset :][: len(texts) + 1].astype(np.int64)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, ends[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), start + most_rows, len(texts))
        yield batch.slice(start, stop - start)
        start = stop


def _offset_type(texts: pa.Array) -> type:
    return np.int64 if texts.type in (pa.large_string(), pa.large_binary()) else np.int32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and where each text starts (and the end)."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) else b"")
    ends = np.frombuffer(texts.buffers()[1], _offset_type(texts))[texts.offset :][: len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return everything[ends[0] : ends[-1]], ends - ends[0]


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` as one table per key value, over batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and (start or held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` about as they come, cut only between values of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        changes = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, changes[-1])])
            held, batch = [], batch.slice(changes[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
