"""Documents that hold passages of a benchmark, found by winnowed fingerprints.

Method: both sides hash the 5-grams of their words and keep, of every 6 consecutive ones, the
least: the fingerprint of that place. A shared span of 10 words has the same 6 grams on both
sides and so a kept one in common; nothing longer can be missed. Fingerprints are joined by
their hash alone. Each hit is then extended to the left and to the right on the words
themselves, as far as they agree, and counts if the whole is 10 words or more. The words that
decide this, 5 on each side, travel with the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.common import ROW, slices, small, small_batches, stored, text_bytes, types, whole_row
from tillhouse.llm.words import ALPHANUMERIC, Words, grams, sliding_min, words

SPAN = 10  # words of a window
GRAM = 5  # k; w follows as SPAN - GRAM + 1
# Bits of the filter that drops fingerprints no benchmark item has. It is this large
# whatever the input is; a fuller one lets more through to the join, never less.
FILTER_BITS = 1 << 25

# Different surroundings of one fingerprint in the benchmark up to which each is extended one
# by one; beyond, the windows they hold are joined by their words.
CONTEXTS = 32

MARK = [("span", pa.int32()), ("start", pa.int32()), ("print", pa.int64()), ("before", pa.int32()), ("near", pa.string())]
MARKS = pa.list_(pa.struct(MARK))
MARKS_SQL = "array<struct<span:int,start:int,print:bigint,before:int,near:string>>"


def gram_of(span: int) -> int:
    """Words of a fingerprint: a shorter item is one as a whole."""
    return GRAM if span == SPAN else span


def fingerprints(found: Words, span: int, present: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the least of a window of ``span`` words.

    ``present``: bits of the hashes that are wanted.
    """
    width = span - gram_of(span) + 1
    prints = grams(found.hash, gram_of(span), seed=span)
    windows = np.flatnonzero(found.left >= span)
    least = np.zeros(len(prints), np.uint64)
    least[windows] = sliding_min(prints, width)[windows]
    marked = np.zeros(len(prints), bool)
    for j in range(width):  # equal grams of a window are marked each
        at = windows[prints[windows + j] == least[windows]] + j
        marked[at] = True
    places = np.flatnonzero(marked)
    if present is not None:
        places = places[_has(present, prints[places])]
    return places, prints[places]


def _has(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints & np.uint64(FILTER_BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _marked(spans: list[int] | None, present: np.ndarray | None, keep: list[str]):
    """Per text its number of words and its marks; ``spans`` None: the text is an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                yield marks_of(part)

    def marks_of(part: pa.RecordBatch) -> pa.RecordBatch:
        data, texts = text_bytes(part.column(part.schema.get_field_index("_text")))
        found = words(data, texts, ALPHANUMERIC)
        folded, counts = ALPHANUMERIC.folded[data].tobytes(), found.counts
        of_word = np.repeat(np.arange(len(counts)), counts)
        rows = []
        for span in spans if spans is not None else range(1, SPAN + 1):
            places, prints = fingerprints(found, span, present)
            text = of_word[places]
            if spans is None:  # an item has one kind of window
                own = np.minimum(counts, SPAN)[text] == span
                places, prints, text = places[own], prints[own], text[own]
            reach = span - gram_of(span)
            low = np.maximum(places - reach, found.first[text])
            high = np.minimum(places + span, found.first[text + 1])
            for t, at, print_, i, j in zip(text.tolist(), places.tolist(), prints.view(np.int64).tolist(), low.tolist(), high.tolist()):
                near = b" ".join([folded[a:b] for a, b in zip(found.start[i:j], found.end[i:j])]).decode()
                rows.append((t, (span, at - found.first[t], print_, at - i, near)))
        rows.sort(key=lambda row: row[0])
        offsets = np.searchsorted(np.array([t for t, _ in rows], np.int64), np.arange(len(counts) + 1))
        columns = list(zip(*(mark for _, mark in rows))) or [()] * len(MARK)
        marks = pa.StructArray.from_arrays(
            [pa.array(c, kind) for c, (_, kind) in zip(columns, MARK)], fields=list(MARKS.value_type)
        )
        return pa.RecordBatch.from_arrays(
            [
                *[part.column(part.schema.get_field_index(c)) for c in keep],
                pa.array(counts.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), marks, type=MARKS),
            ],
            names=[*keep, "n_words", "marks"],
        )

    return run


def _with_marks(rows: DataFrame, spans: list[int] | None, present: np.ndarray | None) -> DataFrame:
    """``rows`` (with ``_text``) without the text, plus ``n_words`` and ``marks``."""
    keep = [c for c in rows.columns if c != "_text"]
    return rows.mapInArrow(_marked(spans, present, keep), types(rows, *keep, n_words="bigint", marks=MARKS_SQL))


def _filter(prints: DataFrame) -> np.ndarray:
    """Bits of the fingerprints; at most FILTER_BITS / 32 rows come to the driver."""
    low = F.col("print").bitwiseAND(F.lit(FILTER_BITS - 1))
    cells = prints.select(
        F.shiftright(low, 5).cast("int").alias("cell"),
        F.expr("shiftleft(1L, cast(print & 31L AS int))").alias("bit"),
    )
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 32, "<u4")
    bits[rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype("<u4")
    return bits.view(np.uint8)


def _agreeing(mine: Column, theirs: Column) -> Column:
    """How many of the first words of two lists agree one by one."""
    differs = F.array_position(F.zip_with(mine, theirs, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(mine)).cast("int")


def extended(hits: DataFrame) -> DataFrame:
    """Hits with the words ``low`` up to ``high`` on which both sides agree; shorter ones than ``span`` go.

    ``hits``: ``span``, ``start``, and of each side the words ``near`` the fingerprint and how many
    of them are ``before`` it.
    """
    gram = F.when(F.col("span") == SPAN, GRAM).otherwise(F.col("span"))
    hits = hits.withColumns({"_mine": F.split("near", " "), "_theirs": F.split("item_near", " ")})

    def side(words: str, before: str) -> tuple[Column, Column]:
        left = F.reverse(F.slice(words, F.lit(1), F.col(before)))
        return left, F.slice(words, F.col(before) + 1, F.size(words))

    (left, right), (item_left, item_right) = side("_mine", "before"), side("_theirs", "item_before")
    hits = hits.withColumns({"_left": _agreeing(left, item_left), "_right": _agreeing(right, item_right)})
    # The fingerprint itself must agree word by word, not in its hash alone.
    hits = hits.filter((F.col("_right") >= gram) & (F.col("_left") + F.col("_right") >= F.col("span")))
    return hits.withColumns({"low": F.col("start") - F.col("_left"), "high": F.col("start") + F.col("_right")})


def _windows(marks: DataFrame, near: str) -> DataFrame:
    """``marks`` once per window of ``span`` words in ``near``: ``window`` and ``offset``, its first word."""
    listed = F.split(near, " ")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(listed) - F.col("span")), lambda i: F.array_join(F.slice(listed, i + 1, F.col("span")), " ")
    )
    return marks.select("*", F.posexplode(windows).alias("offset", "window"))


def _hits(marks: DataFrame, items: DataFrame) -> DataFrame:
    """``_id``, ``item_id``, ``low``, ``high`` of all agreements of ``marks`` and ``items``."""
    contexts = items.select("span", "print", "item_before", "item_near").distinct()
    wide = contexts.groupBy("span", "print").count().filter(F.col("count") > CONTEXTS).select("span", "print")
    wide = small(stored(wide))
    narrow = items.join(wide, ["span", "print"], "left_anti")
    hits = extended(marks.join(small(stored(narrow)), ["span", "print"])).select("_id", "item_id", "low", "high")
    if wide.isEmpty():
        return hits
    # A fingerprint that stands in many ways in the benchmark.
    theirs = _windows(items.join(wide, ["span", "print"], "left_semi"), "item_near").select("span", "window", "item_id").distinct()
    mine = _windows(marks.join(wide, ["span", "print"], "left_semi"), "near")
    low = F.col("start") - F.col("before") + F.col("offset")
    joined = mine.join(small(stored(theirs)), ["span", "window"])
    return hits.unionByName(joined.select("_id", "item_id", low.alias("low"), (low + F.col("span")).alias("high")))


def _searched(docs: DataFrame, benchmark: DataFrame, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with ``_id``, ``keep`` and ``n_words``; and hits and items of those with hits."""
    items = stored(
        _with_marks(small_batches(benchmark).select("item_id", F.coalesce("text", F.lit("")).alias("_text")), None, None)
        .select("item_id", F.explode("marks").alias("mark"))
        .select("item_id", "mark.span", "mark.print", F.col("mark.before").alias("item_before"), F.col("mark.near").alias("item_near"))
        .distinct()
    )
    spans = sorted(r["span"] for r in items.select("span").distinct().collect())  # ten at most
    texts = docs.select(F.monotonically_increasing_id().alias("_id"), *keep, F.coalesce("text", F.lit("")).alias("_text"))
    rows = stored(_with_marks(texts, spans, _filter(items)))
    marks = rows.select("_id", F.explode("marks").alias("mark")).select("_id", "mark.*")
    found = _hits(marks, items).groupBy("_id").agg(
        F.sort_array(F.collect_set(F.struct("low", "high"))).alias("_spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_items"),
    )
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["high"] - F.greatest(s["low"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["high"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    found = found.select(
        "_id", covered.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.array_join("_items", ",").alias("_joined")
    )
    return rows.drop("marks"), stored(found)


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): what it shares with ``benchmark``.

    Columns: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    An item's windows are its runs of 10 words, or the item as a whole if it has fewer. A
    document word is hit if any occurrence of a window covers it. Texts of any length are
    read whole. Null and empty texts have no words, as documents and as items; a null
    ``item_id`` hits words but is not counted among the items, and rows that repeat an item
    change nothing. Repeated documents are judged each. Empty tables on either side give no
    hits. Other columns are ignored.
    """
    rows, found = _searched(docs, benchmark, F.col("doc_id"))
    zero = F.lit(0).cast("long")
    hit = F.coalesce("n_hit", zero)
    return rows.join(small(found), "_id", "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("_joined", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, see :func:`judged`, with their columns as they came.

    Texts are named by two hashes and their length; those with a hit leave with all their rows.
    """
    text = F.coalesce("text", F.lit(""))
    name = [F.xxhash64(text).alias("_h1"), F.crc32(text.cast("binary")).alias("_h2"), F.octet_length(text).alias("_n")]
    names = ["_h1", "_h2", "_n"]
    rows, found = _searched(docs, benchmark, *name)
    hit = stored(rows.join(small(found.select("_id")), "_id", "left_semi").select(*names).distinct())
    return docs.select(whole_row(docs), *name).join(small(hit), names, "left_anti").select(f"{ROW}.*")
