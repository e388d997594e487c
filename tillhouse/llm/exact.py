"""Exact duplicates by merging sorted digest runs up a tree.

Method: every document becomes an entry of digests, its id and a count. The entries of a
scan task are a run, sorted, with one entry per text. Runs exchange their entries in rounds:
in round r each run hands the entries whose digest has the r-th digit d to the partner whose
number has that digit there, and merges in sorted order what its partners hand to it; equal
entries become one with the smallest id and the summed count. After the last round each run
holds all entries of its digits, so no task ever holds more than its share, and a text that
a third of the rows have is one entry per run from the first round on. Only DataFrame
functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.common import ROW, SMALL_ROWS, small, stored, whole_row
from tillhouse.operators.skew import fits_broadcast

# A run of white space, which counts as one space (fixed value).
SPACE_RUN = r"[\x20\x09-\x0D]+"
# Runs that meet in one merge, and entries of one run, about.
FAN = 8
RUN_ROWS = 2_000_000
# Rows of one text from which on they are not shuffled to one task.
HOT_ROWS = 100_000
# What names a text. Two texts of one SHA-256 would still be apart at every level, by their
# bytes and a second hash.
KEY = ("digest", "n_bytes", "check")


def _named(text: Column) -> dict[str, Column]:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")
    return {
        "digest": F.sha2(text.cast("binary"), 256),
        "n_bytes": F.octet_length(text).cast("long"),
        "check": F.xxhash64(text),
    }


def entries(docs: DataFrame) -> DataFrame:
    """A narrow row per row of ``docs``, with its number ``at``; texts are read here alone."""
    return docs.select(
        "doc_id", F.monotonically_increasing_id().alias("at"), *[c.alias(n) for n, c in _named(F.col("text")).items()]
    )


def levels_for(runs: int, fan: int) -> int:
    levels = 1
    while fan**levels < runs:
        levels += 1
    return levels


def merged(rows: DataFrame, fan: int = FAN, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per text of :func:`entries`: its key, ``n`` rows and ``first``, the row that stays.

    ``first`` is the row with the smallest doc_id (null after all others), of rows that
    repeat it the first read.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = levels_for(max(width, -(-rows.count() // run_rows)), fan)
    runs = fan**levels
    # The run a digest ends in, digit by digit; its first 15 hex digits fit a long.
    goal = F.pmod(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"), F.lit(runs))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    held = rows.select(F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), *KEY, first.alias("first"), F.lit(1).cast("long").alias("n"))
    for level in range(levels):
        low, high = fan**level, fan ** (level + 1)
        digit = F.floor(F.pmod(goal, F.lit(high)) / low)
        run = F.floor(F.col("run") / high) * high + digit * low + F.pmod("run", F.lit(low))
        held = held.withColumn("run", run.cast("int"))
        if level:  # before the first round the tasks of the scan are the runs
            held = held.repartitionById(runs, "run")
        # Sorted aggregation: a task merges and never holds more than one text's entry.
        held = held.groupBy("run", *KEY).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    return held.drop("run")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``first`` and ``n`` of their text where several rows have it."""
    repeated = groups.filter("n > 1")
    if fits_broadcast(repeated, SMALL_ROWS):
        return rows.join(F.broadcast(repeated), [*KEY], "left")
    # Texts of many rows are few: at most SMALL_ROWS have more than this share of all.
    most = max(HOT_ROWS, rows.count() // SMALL_ROWS)
    hot = F.broadcast(repeated.filter(F.col("n") > most))
    others = rows.join(hot, [*KEY], "left_anti").join(repeated.filter(F.col("n") <= most), [*KEY], "left")
    return rows.join(hot, [*KEY]).unionByName(others)


def _judged(docs: DataFrame) -> DataFrame:
    rows = stored(entries(docs))
    found = _with_groups(rows, stored(merged(rows)))
    return found.select(
        "doc_id",
        *KEY,
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.at") == F.col("at"), F.lit(True)).alias("kept"),
    )


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``), dropped ones too.

    Columns: ``doc_id``, ``keep_id`` (of the row that stays), ``group_size``, ``kept`` and
    ``text_sha256`` of the normalised text.

    Texts are equal if they are after each run of white space became one space; texts of any
    length are read to their end, and a null text counts as empty. Of equal texts the row
    with the smallest doc_id stays; of rows that repeat that id too, exactly one. A null
    doc_id counts as larger than all others, so ``keep_id`` is null only in groups without
    any id. Other columns are ignored; an empty table gives an empty result.
    """
    return _judged(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def distinct(docs: DataFrame) -> DataFrame:
    """The rows that stay, see :func:`judged`, with their columns as they came."""
    found = stored(_judged(docs))
    name = ["doc_id", *KEY]
    lost = found.filter("not kept").select(*name).distinct()
    both = lost.join(found.filter("kept").select(*name), _same(lost, found.filter("kept"), name), "left_semi")
    rows = docs.select(whole_row(docs), "doc_id", *[c.alias(n) for n, c in _named(F.col("text")).items()])
    rest = rows.join(small(lost), _same(rows, lost, name), "left_anti")
    again = rows.join(small(both), _same(rows, both, name), "left_semi").dropDuplicates(name)
    return rest.unionByName(again).select(f"{ROW}.*")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, [left[n].eqNullSafe(right[n]) for n in names])
