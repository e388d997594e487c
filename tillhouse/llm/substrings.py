"""Passages that a document with a smaller id has already, word by word.

Method: each window of 50 words is led to an index shard by the least hash of the word
8-grams in it, so that equal windows meet in one shard whatever documents they are in.
Consecutive windows with the same least hash travel as one segment, and only those whose
least hash other documents have too. A shard holds an FM-index of its distinct segments;
every segment is searched backwards in it, which gives for each window the smallest
document that has it, and the intervals that an earlier document covers are reported. A
least hash whose segments are more than a shard is spread by single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.llm.common import ROW, grouped, slices, small, small_batches, small_lists, stored, text_bytes, types, whole_row
from tillhouse.llm.fm_index import FMIndex
from tillhouse.llm.words import BY_SPACE, grams, same_words, sliding_min, words

WINDOW = 50
GRAM = 8
# Windows of one segment; a longer run is cut into overlapping segments.
SEGMENT = 512
# Segments per least hash above which its windows are counted one by one first.
HOT = 5000
# Bytes of distinct segments in one index shard, about.
SHARD_BYTES = 2 << 20
# And of one least hash beyond which its windows are indexed one by one.
HEAVY_BYTES = SHARD_BYTES

RUN = "struct<anchor:bigint,start:int,stop:int>"
RUNS = pa.list_(pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]))


def runs_of(found, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same least gram: their text, that gram, first word and end."""
    valid = np.flatnonzero(found.left >= window)
    if not len(valid):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    least = sliding_min(grams(found.hash, GRAM), window - GRAM + 1)[valid]
    text = np.repeat(np.arange(len(found.counts)), found.counts)[valid]
    opens = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
    sizes = np.diff(np.append(opens, len(valid)))
    pieces = -(-sizes // SEGMENT)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    opens, sizes = np.repeat(opens, pieces) + within * SEGMENT, np.repeat(sizes, pieces) - within * SEGMENT
    start = valid[opens] - found.first[text[opens]]
    return text[opens], least[opens].view(np.int64), start, start + np.minimum(sizes, SEGMENT) - 1 + window


def _with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = words(*text_bytes(part.column(2)), BY_SPACE)
            text, anchor, start, stop = runs_of(found)
            ends = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays(
                [pa.array(anchor), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
                fields=list(RUNS.value_type),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(found.counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), runs, type=RUNS),
                ],
                names=["doc_id", "key", "n_words", "runs"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the given runs with a hash of all its words."""
    for batch in batches:
        for part in slices(batch, "text"):
            found = words(*text_bytes(part.column(2)), BY_SPACE)
            whole = grams(found.hash, WINDOW).view(np.int64)
            for i, runs in enumerate(part.column(3).to_pylist()):
                anchor = np.concatenate([np.full(r["stop"] - r["start"] - WINDOW + 1, r["anchor"]) for r in runs])
                at = np.concatenate([np.arange(r["start"], r["stop"] - WINDOW + 1) for r in runs])
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.full(n, i))),
                        part.column(1).take(pa.array(np.full(n, i))),
                        pa.array(anchor),
                        pa.array(at.astype(np.int32)),
                        pa.array(whole[found.first[i] + at]),
                    ],
                    names=["doc_id", "key", "anchor", "start", "whole"],
                )


def _joined_runs(runs: list[dict]) -> list[tuple[int, int, int]]:
    """Runs in order, where single windows next to each other become one again."""
    out: list[tuple[int, int, int]] = []
    for anchor, start, stop in sorted((r["anchor"], r["start"], r["stop"]) for r in runs):
        if out and out[-1][0] == anchor and start == out[-1][2] - WINDOW + 1 and stop - out[-1][1] < SEGMENT + WINDOW:
            out[-1] = (anchor, out[-1][1], stop)
        else:
            out.append((anchor, start, stop))
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each run, joined by one space."""
    for batch in batches:
        for part in slices(batch, "text"):
            docs, keys, anchors, starts, contents = [], [], [], [], []
            for doc, key, text, runs in zip(*(c.to_pylist() for c in part.columns)):
                all_words = text.encode().split()
                for anchor, start, stop in _joined_runs(runs):
                    docs.append(doc)
                    keys.append(key)
                    anchors.append(anchor)
                    starts.append(start)
                    contents.append(b" ".join(all_words[start:stop]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, part.schema[0].type), pa.array(keys, pa.binary()), pa.array(anchors, pa.int64()),
                    pa.array(starts, pa.int32()), pa.array(contents, pa.binary()),
                ],
                names=["doc_id", "key", "anchor", "start", "content"],
            )


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment of a shard the runs of windows with the same smallest document."""
    for rows in grouped(batches, "shard"):
        data, texts = text_bytes(rows.column("content").combine_chunks())
        found = words(data, texts, BY_SPACE)
        symbols = same_words(data, found)  # no two words are one symbol
        index = FMIndex(symbols, found.first, rows.column("doc_id").to_numpy().astype(np.int64), WINDOW)
        least, first = index.least_numbers(symbols, found.first)
        owner = np.repeat(np.arange(rows.num_rows), np.diff(first))
        opens = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
        sizes = np.diff(np.append(opens, len(least)))
        at = opens - first[owner[opens]]
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("segment").combine_chunks().take(pa.array(owner[opens])),
                pa.array(least[opens]),
                pa.array(at.astype(np.int32)),
                pa.array((at + sizes - 1 + WINDOW).astype(np.int32)),
            ],
            names=["segment", "least", "low", "high"],
        )


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments, each with its own words."""
    for batch in batches:
        for part in slices(batch, "content"):
            owners, at, contents = [], [], []
            for i, content in enumerate(part.column(2).to_pylist()):
                all_words = content.split(b" ")
                n = len(all_words) - WINDOW + 1
                owners += [i] * n
                at += range(n)
                contents += [b" ".join(all_words[j : j + WINDOW]) for j in range(n)]
            owners = pa.array(owners, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(owners), part.column(1).take(owners), pa.array(at, pa.int32()), pa.array(contents, pa.binary())],
                names=["doc_id", "segment", "at", "content"],
            )


def _least(distinct: DataFrame) -> DataFrame:
    """For each of the ``distinct`` segments the runs of windows with the same smallest document.

    Columns ``segment``, ``least``, ``low``, ``high``. All segments of a least hash are one
    shard, unless they are larger than a shard should be: then their windows are indexed one
    by one, and each distinct window may lie in a shard of its own.
    """
    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    sizes = stored(distinct.groupBy("anchor").agg(F.sum(F.octet_length("content")).alias("bytes")))
    heavy = sizes.filter(F.col("bytes") > HEAVY_BYTES).select("anchor")
    spread = not heavy.isEmpty()

    def searched(rows: DataFrame, spot: Column) -> DataFrame:
        size = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        shards = max(width, -(-size // SHARD_BYTES))
        dealt = rows.select(F.pmod(spot, F.lit(shards)).cast("int").alias("shard"), doc_id, "segment", "content")
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
        return stored(dealt.mapInArrow(_searched, "segment binary, least bigint, low int, high int"))

    light = distinct.join(small(heavy), "anchor", "left_anti") if spread else distinct
    least = searched(light, F.xxhash64("anchor"))
    if not spread:
        return least
    pieces = stored(
        distinct.join(small(heavy), "anchor")
        .select("doc_id", "segment", "content")
        .mapInArrow(_single, types(distinct, "doc_id", "segment", at="int", content="binary"))
        .withColumn("window", F.unhex(F.md5("content")))
    )
    windows = stored(pieces.groupBy("window", "content").agg(F.min("doc_id").alias("doc_id")))
    single = searched(windows.withColumnRenamed("window", "segment"), F.xxhash64("segment"))
    single = pieces.select("segment", "at", "window").join(single.select(F.col("segment").alias("window"), "least"), "window")
    # Neighbours with the same document are one run again.
    along = Window.partitionBy("segment").orderBy("at")
    single = single.withColumn("_new", F.coalesce((F.lag("least").over(along) != F.col("least")).cast("int"), F.lit(1)))
    single = single.withColumn("_run", F.sum("_new").over(along)).groupBy("segment", "_run")
    runs = single.agg(F.min("least").alias("least"), F.min("at").alias("low"), (F.max("at") + WINDOW).alias("high"))
    return least.unionByName(stored(runs.drop("_run")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their intervals."""
    for batch in batches:
        for part in slices(batch, "text"):
            totals, removed, kept = [], [], []
            for text, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                all_words = text.encode().split()
                rest, at, gone = [], 0, 0
                for cut in sorted(cuts or [], key=lambda c: c["low"]):
                    low, high = max(cut["low"], at), min(cut["high"], len(all_words))
                    if high > low:
                        rest += all_words[at:low]
                        gone += high - low
                        at = high
                rest += all_words[at:]
                totals.append(len(all_words))
                removed.append(gone)
                kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["carried", "n_words", "n_removed", "kept"],
            )


def _document_key() -> list:
    """A document is its id and text: rows that repeat an id with another text are apart."""
    return [F.col("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key")]


def intervals(docs: DataFrame) -> DataFrame:
    """Per document (``doc_id``, ``key``) the word intervals ``cuts`` to be removed from it.

    Only documents with such intervals have a row; see :func:`removed`.
    """
    texts = small_batches(docs).filter(F.col("doc_id").isNotNull()).select(*_document_key(), F.coalesce("text", F.lit("")).alias("text"))
    base = stored(texts.mapInArrow(_with_runs, types(texts, "doc_id", "key", n_words="bigint", runs=f"array<{RUN}>")))
    long = base.filter(F.col("n_words") >= WINDOW)
    # Of equal texts the first stands for all; all windows of the others are its windows.
    firsts = stored(long.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("runs").alias("runs")))
    repeated = firsts.filter("n > 1").select("key", F.col("doc_id").alias("_first"))
    copies = long.select("doc_id", "key", "n_words").join(repeated, "key").filter(F.col("doc_id") > F.col("_first"))
    copies = copies.distinct().select(
        "doc_id", "key", F.lit(0).alias("low"), F.col("n_words").cast("int").alias("high")
    )

    anchors = firsts.select("doc_id", "key", F.explode("runs").alias("run")).select("doc_id", "key", "run.*")
    shared = stored(
        anchors.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
        .select("anchor", "n")
    )
    candidates = anchors.join(shared, "anchor")
    run = F.struct("anchor", "start", "stop").alias("run")

    def lists(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("doc_id", "key").agg(F.collect_list(run).alias("runs")))

    def with_text(wanted: DataFrame) -> DataFrame:
        return texts.join(small_lists(wanted, "runs"), ["doc_id", "key"]).select("doc_id", "key", "text", "runs")

    wanted = candidates.filter(F.col("n") <= HOT).select("doc_id", "key", "anchor", "start", "stop")
    hot = shared.filter(F.col("n") > HOT)
    if not hot.isEmpty():
        # A very common gram: only windows that two documents have as a whole go on.
        windows = stored(
            with_text(lists(candidates.filter(F.col("n") > HOT))).mapInArrow(
                _windows, types(texts, "doc_id", "key", anchor="bigint", start="int", whole="bigint")
            )
        )
        both = (
            windows.groupBy("anchor", "whole")
            .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
            .filter("low < high")
            .select("anchor", "whole")
        )
        wanted = wanted.unionByName(
            windows.join(both, ["anchor", "whole"], "left_semi").select(
                "doc_id", "key", "anchor", "start", (F.col("start") + WINDOW).alias("stop")
            )
        )
    segments = stored(
        with_text(lists(wanted))
        .mapInArrow(_segments, types(texts, "doc_id", "key", anchor="bigint", start="int", content="binary"))
        .withColumn("segment", F.unhex(F.md5(F.concat("content", F.col("anchor").cast("string").cast("binary")))))
    )
    distinct = stored(segments.groupBy("anchor", "segment", "content").agg(F.min("doc_id").alias("doc_id")))
    least = _least(distinct)
    found = (
        segments.select("doc_id", "key", "segment", "start")
        .join(least, "segment")
        .filter(F.col("least") < F.col("doc_id"))
        .select("doc_id", "key", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    )
    return stored(
        found.unionByName(copies).groupBy("doc_id", "key").agg(F.collect_set(F.struct("low", "high")).alias("cuts"))
    )


def removed(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, whole numbers, and ``text``) without repeated passages.

    Columns: ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the other words joined by
    one space.

    A word goes if a window of 50 consecutive words over it also starts in a document with a
    smaller doc_id. Windows are those of the input; what was removed elsewhere counts too.
    Texts and words of any length are searched whole, and no word is taken for another.
    Passages that repeat only inside a document, or in rows with the same doc_id, stay. A
    null doc_id is neither smaller nor larger than another, so its row stays whole. A null
    text has no words; texts under 50 words stay whole. An empty table gives an empty result.
    Other columns are ignored.
    """
    cuts = small_lists(intervals(docs), "cuts")
    texts = docs.select(docs["doc_id"].alias("carried"), *_document_key(), F.coalesce("text", F.lit("")).alias("text"))
    return _without(texts.join(cuts, ["doc_id", "key"], "left")).withColumnRenamed("carried", "doc_id")


def _without(rows: DataFrame) -> DataFrame:
    rows = rows.select("carried", "text", "cuts")
    return rows.mapInArrow(_cut, types(rows, "carried", n_words="bigint", n_removed="bigint", kept="string"))


def shortened(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that lose nothing, as they are, and those that lose words.

    The second frame has the row under ``_row``, and ``n_words``, ``n_removed`` and ``kept`` as
    :func:`removed`; only its texts leave the JVM.
    """
    cuts = small_lists(intervals(docs), "cuts")
    rows = docs.select(whole_row(docs), *_document_key())
    whole = rows.join(cuts.select("doc_id", "key"), ["doc_id", "key"], "left_anti").select(f"{ROW}.*")
    cut = rows.join(cuts, ["doc_id", "key"]).select(F.col(ROW).alias("carried"), F.col(ROW)["text"].alias("text"), "cuts")
    return whole, _without(cut).withColumnRenamed("carried", ROW)


def digests(docs: DataFrame) -> DataFrame:
    return removed(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
