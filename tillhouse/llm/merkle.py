"""A Merkle manifest of a dataset, with a witness per row from appends in a stream.

Method: the leaves of a source are cut into aligned blocks of 3 ** 7. A task appends the
leaves of a block one after the other: at most three nodes per level are open, each with the
range of leaves below it. A new leaf starts an empty witness; when the siblings of an open
subtree are complete, they are attached to the witnesses of all leaves below it, and the
run of three becomes one node of the next level. The block roots are then leaves to append
themselves, in blocks of their own, until one root is left; the witness of a block root
continues that of its leaves. The roots of the sources are appended the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.llm.common import grouped, parallel, small, stored, types

# Children of a node, and levels that one task closes: its blocks have ARITY ** LEVELS leaves.
ARITY = 3
LEVELS = 7
# Rows of one range when leaves are numbered, and leaves that one task appends, about.
RANGE_ROWS = 1_000_000
TASK_ROWS = 100_000
# Witnesses, of about 1 KB each, that are sent to every executor.
SMALL_WITNESSES = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_DIGEST = 32


def node(digests: list[bytes]) -> bytes:
    """Digest of a node from those of its children, which count as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a row: each field `-` if null, else its UTF-8 byte count, `:` and its value."""
    fields = [_field(changed.get(name, F.col(name))) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


class Block:
    """Leaves appended one by one; a witness per leaf grows as its siblings are completed."""

    def __init__(self, size: int, levels: int):
        self.digests = np.zeros((size, levels, ARITY - 1, _DIGEST), np.uint8)
        self.counts = np.zeros((size, levels), np.int64)
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]
        self.levels, self.size = levels, 0

    def append(self, digest: bytes) -> None:
        self.open[0].append((digest, self.size, self.size + 1))
        self.size += 1
        level = 0
        while level < self.levels and len(self.open[level]) == ARITY:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        """The open run of a level becomes a node of the next; its leaves get their siblings."""
        run = self.open[level]
        for i, (_, low, high) in enumerate(run):
            siblings = [d for j, (d, _, _) in enumerate(run) if j != i]
            if siblings:
                self.digests[low:high, level, : len(siblings)] = np.frombuffer(b"".join(siblings), np.uint8).reshape(-1, _DIGEST)
            self.counts[low:high, level] = len(siblings)
        self.open[level + 1].append((node([d for d, _, _ in run]), run[0][1], run[-1][2]))
        self.open[level] = []

    def close(self, whole: bool) -> bytes:
        """Root of the block; one that is a tree by itself (``whole``) stops at a lone node."""
        for level in range(self.levels):
            above = any(self.open[level + 1 :])
            if self.open[level] and (above or len(self.open[level]) > 1 or not whole):
                self._complete(level)
        return next(run[0][0] for run in self.open if run)

    def witnesses(self) -> pa.Array:
        """Per leaf the digests of its siblings, from the bottom to the top, left to right."""
        there = np.arange(ARITY - 1) < self.counts[: self.size, :, None]
        ends = np.append(0, np.cumsum(there.sum((1, 2)) * _DIGEST)).astype(np.int32)
        data = self.digests[: self.size][there]
        return pa.Array.from_buffers(pa.binary(), self.size, [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def _appended(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks, each in the order of its leaves, with ``witness`` and ``top``."""
        for rows in grouped(batches, "_key"):
            block = Block(rows.num_rows, levels)
            for digest in rows.column("digest").to_pylist():
                block.append(digest)
            top = block.close(whole=rows.column("n")[0].as_py() <= ARITY**levels)
            tops = pa.array([top], pa.binary()).take(pa.array(np.zeros(rows.num_rows, np.int32)))
            given = rows.drop_columns(["_key"])
            yield pa.RecordBatch.from_arrays(
                [*(c.combine_chunks() for c in given.columns), block.witnesses(), tops],
                names=[*given.column_names, "witness", "top"],
            )

    return run


def numbered(rows: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with their place ``at`` in their ``tree`` and the size ``n`` of the tree.

    Rows are range-partitioned by tree and order, and numbered inside a range; the counts of
    the ranges before it give the rest. A tree with most of the rows is many ranges.
    """
    ranged = stored(
        rows.repartitionByRange(parallel(rows, range_rows), "tree", *order).withColumn("_range", F.spark_partition_id())
    )
    counts = ranged.groupBy("tree", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(
        counts.select(
            "tree", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy("tree")).alias("n"),
        )
    )
    inside = F.row_number().over(Window.partitionBy("_range", "tree").orderBy(*order))
    placed = ranged.withColumn("_row", inside).join(small(counts), ["tree", "_range"])
    return placed.withColumn("at", F.col("_before") + F.col("_row") - 1).drop("_before", "_row", "_range")


def witnessed(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``leaves`` with the ``witness`` of each in its tree and the tree's ``root``.

    ``leaves`` has ``tree`` (not null), ``at`` from 0, ``n`` leaves of the tree and ``digest``;
    its other columns travel along.
    """
    size = ARITY**levels
    leaves = leaves.withColumn("block", F.floor(F.col("at") / size).cast("long"))
    tasks = parallel(leaves, TASK_ROWS)
    done = stored(
        leaves.withColumn("_key", F.concat(F.col("block").cast("string"), F.lit(" "), F.col("tree")))
        .repartition(tasks, "_key")
        .sortWithinPartitions("_key", "at")
        .mapInArrow(_appended(levels), types(leaves, *leaves.columns, witness="binary", top="binary"))
    )
    if done.filter(F.col("n") > size).isEmpty():
        return done.drop("block").withColumnRenamed("top", "root")
    tops = done.filter(F.col("at") % size == 0)
    above = witnessed(
        tops.select(
            "tree", F.col("block").alias("at"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("digest")
        ),
        levels,
    )
    above = above.select("tree", F.col("at").alias("block"), F.col("witness").alias("_above"), "root")
    joined = done.join(small(above, SMALL_WITNESSES), ["tree", "block"])
    return joined.withColumn("witness", F.concat("witness", "_above")).drop("block", "top", "_above")


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs`` with its leaf, its witness up to the root and the root.

    Columns: ``doc_id``, ``leaf``, ``changed`` (the leaf if the columns ``tampered`` are put in
    the place of those of that name), ``subroot`` of its source and ``root``, as bytes;
    ``at`` and ``n``, its place and the leaves of its source, ``witness``, the siblings in the
    source's tree; ``source_at``, ``n_sources`` and ``source_witness`` the same of the source.

    Leaves of a source ascend by doc_id (null first), then by digest; sources ascend bytewise,
    null first. Texts of any length are read whole; a null field is `-` in the leaf and so
    differs from an empty one. Rows that repeat are leaves each. An empty table has no rows.
    Other columns are ignored.
    """
    rows = stored(
        docs.select(
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree"),
            "doc_id",
            leaf_digest().alias("digest"),
            leaf_digest(**tampered).alias("changed") if tampered else F.lit(None).cast("binary").alias("changed"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    leaves = witnessed(numbered(rows, ["doc_id", "digest", "_row"]).drop("_row"), levels)
    sources = leaves.filter("at = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    sources = witnessed(numbered(sources, ["name"]), levels).select(
        F.col("name").alias("tree"), F.col("at").alias("source_at"), F.col("n").alias("n_sources"),
        F.col("witness").alias("source_witness"), "root",
    )
    leaves = leaves.withColumnsRenamed({"digest": "leaf", "root": "subroot"})
    return leaves.join(small(stored(sources), SMALL_WITNESSES), "tree").drop("tree")


def folded(digest: bytes, at: int, n: int, witness: bytes) -> bytes:
    """Root of a tree of ``n`` leaves from one of them and the siblings of its witness."""
    low = 0
    while n > 1:
        place, others = at % ARITY, min(ARITY, n - at // ARITY * ARITY) - 1
        mid, high = low + place * _DIGEST, low + others * _DIGEST
        digest = hashlib.sha256((witness[low:mid] + digest + witness[mid:high]).hex().encode()).digest()
        low, at, n = high, at // ARITY, -(-n // ARITY)
    return digest


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, roots = [], []
        for row in batch.to_pylist():
            proofs.append(hashlib.sha256((row["witness"] + row["source_witness"]).hex().encode()).hexdigest())
            subroot = folded(row["changed"] or row["leaf"], row["at"], row["n"], row["witness"])
            roots.append(folded(subroot, row["source_at"], row["n_sources"], row["source_witness"]))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "leaf", "subroot", "root")),
                pa.array(proofs, pa.string()),
                pa.array(roots, pa.binary()),
            ],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
        )


def verified(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs`` with every row folded up to the root again, half of them tampered.

    A row whose decimal doc_id has an even CRC-32 lost the line ends of its text; a null
    doc_id has none and stays. Columns: ``doc_id``, ``leaf``, ``subroot``, ``root`` and
    ``proof_sha256`` (of the witness) of the rows as given, ``folded_root`` from the tampered
    leaf and the given witness, ``verified``. See :func:`manifest` for odd rows.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(F.coalesce(even, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(docs, {"text": text}, levels)
    out = rows.mapInArrow(
        _proved, types(rows, "doc_id", "leaf", "subroot", "root", proof_sha256="string", folded_root="binary")
    )
    names = ("leaf", "subroot", "root", "folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumns({n: F.lower(F.hex(n)) for n in names})
