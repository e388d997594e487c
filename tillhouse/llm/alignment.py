"""Tokens of two vocabularies over the same text: common ends, groups and overlapping pairs.

Method: every token of both sides ends at a byte offset. The shorter of the two lists of ends
drives a galloping search into the longer: from where the last search stopped the steps
double until they are past the end looked for, then the last step is halved. Ends found on
both sides cut the tokens into groups, and the ranks of neighbouring ends differ by the
tokens that one token overlaps. Pairs that overlap are counted over all documents, and each
document is weighed by these counts.

No token of either vocabulary reaches over a single space or line end between two other
characters (this is checked), so texts are encoded in such pieces; a piece that was seen
before is looked up.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tillhouse.llm.common import slices, small, small_batches, stored, types
from tillhouse.operators.skew import fits_broadcast

# Consecutive ends that one lane of the galloping search goes through.
LANE = 16
# Characters of one text that are handled at once, about, and pieces that are remembered.
CHUNK = 1 << 18
REMEMBERED = 1 << 18
# New pieces that are encoded in a row.
ROW_PIECES = 64
# Pairs that are sent to every executor.
SMALL_PAIRS = 1_000_000

# A piece: its space or line end and what follows up to the next such place. White space
# here is at least what any of the two libraries takes for it.
_SPACE = r"\s᠎​﻿"
PIECES = re.compile(rf"(?:[ \n][^{_SPACE}]+|[{_SPACE}]+[^{_SPACE}]*)(?:(?![ \n][^{_SPACE}])[{_SPACE}]+[^{_SPACE}]*)*")
JOINS = re.compile(rf"[ \n][^{_SPACE}](?:.*[^{_SPACE}])?", re.DOTALL)
BORDER = re.compile(rf"(?<=[^{_SPACE}])(?=[ \n][^{_SPACE}])")

LINKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and that byte.

    Printable bytes stand for themselves, the others are numbered on from 256 in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """First place in ``long`` whose entry is not below each entry of ``short``; both ascend."""
    if not len(short):
        return np.zeros(0, np.int64)
    lanes = -(-len(short) // LANE)
    wanted = np.full(lanes * LANE, short[-1])
    wanted[: len(short)] = short
    wanted = wanted.reshape(lanes, LANE).T
    long = np.append(long, np.iinfo(np.int64).max)
    out, at = np.empty((LANE, lanes), np.int64), np.zeros(lanes, np.int64)
    for i, x in enumerate(wanted):
        open_ = np.flatnonzero(long[at] < x)
        if len(open_):
            x, low, step = x[open_], at[open_], np.ones(len(open_), np.int64)
            while True:  # everything up to low is below x
                high = np.minimum(low + step, len(long) - 1)
                below = long[high] < x
                if not below.any():
                    break
                low, step = np.where(below, high, low), np.where(below, 2 * step, step)
            while (high - low > 1).any():
                middle = (low + high) >> 1
                below = long[middle] < x
                low, high = np.where(below, middle, low), np.where(below, high, middle)
            at[open_] = high
        out[i] = at
    return out.T.ravel()[: len(short)]


class Pair:
    """The two tokenizers of one process, with the pieces they have met."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        code = byte_characters()
        bytes_a = {i: bytes(code[c] for c in entry) for entry, i in entries.items()}
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.space = [pieces.index("▁")] if "▁" in pieces else []
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.lengths = [np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        # What a token writes into the text of the groups: in a side, and as the last of it.
        self.written = [
            f"{i}{end}".encode() for side, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for i in range(len(side)) for end in ends
        ]
        self.known = {}
        self._forget()

    def _forget(self) -> None:
        """Remember nothing but the pieces that came again since they were learned."""
        again = [p for p, i in self.known.items() if self.met[i] > 1] if self.known else []
        self.known: dict[str, int] = {}
        self.ids = (array("i"), array("i"))
        self.ends = (array("q", [0]), array("q", [0]))
        self.same = array("b")
        self.met = np.zeros(REMEMBERED, np.int64)
        if len(again) <= REMEMBERED // 2:
            self._learn(again)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces, each with the space or line end before it.

        They are encoded in short rows: no token reaches from one piece into the next. Rows
        whose bytes do not come back are encoded piece by piece.
        """
        whole = [p for p in pieces if JOINS.fullmatch(p)] if self.cuts else []
        rows = [whole[i : i + ROW_PIECES] for i in range(0, len(whole), ROW_PIECES)]
        if rows and not self._learn_rows(rows):
            rows = [row for row in rows if not self._learn_rows([row])]
            pieces = [p for p in pieces if p not in self.known]
        else:
            pieces = [p for p in pieces if p not in self.known] if len(whole) < len(pieces) else []
        if pieces:
            self._learn_each(pieces)

    def _learn_rows(self, rows: list[list[str]]) -> bool:
        texts = ["".join([" x", *row]) for row in rows]  # the second vocabulary puts the first space in front by itself
        data = "".join(texts).encode()
        sizes = [n for row in rows for n in (2, *map(len, map(str.encode, row)))]
        opens = np.cumsum([0, *(len(row) + 1 for row in rows)])[:-1]  # where the x of each row is
        borders, sides = np.cumsum(sizes), []
        for lists, table, lengths in zip(
            ([e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)),
            (self.bytes_a, self.bytes_b), self.lengths,
        ):
            flat = list(chain.from_iterable(lists))
            if b"".join(map(table.__getitem__, flat)) != data:
                return False
            ids = np.array(flat, np.int32)
            ends = np.cumsum(lengths[ids])
            cuts = np.searchsorted(ends, borders)
            if (ends[cuts] != borders).any():
                return False
            counts = np.diff(np.append(-1, cuts))
            kept = np.ones(len(sizes), bool)
            kept[opens] = False
            sides.append((ids[np.repeat(kept, counts)], np.cumsum(counts[kept])))
        pieces = [p for row in rows for p in row]
        self._hold(pieces, sides, [1] * len(pieces))
        return True

    def _learn_each(self, pieces: list[str]) -> None:
        sides = (
            [e.ids for e in self.a.encode_batch(pieces, add_special_tokens=False)],
            self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1),
        )
        sides[1][:] = [ids[1:] if p[0] != " " and ids[:1] == self.space else ids for p, ids in zip(pieces, sides[1])]
        same = [
            b"".join([self.bytes_a[i] for i in a]) == p.encode() == b"".join([self.bytes_b[i] for i in b])
            for p, a, b in zip(pieces, *sides)
        ]
        held = [(np.array(list(chain.from_iterable(x)), np.int32), np.cumsum([len(i) for i in x])) for x in sides]
        self._hold(pieces, held, same)

    def _hold(self, pieces: list[str], sides, same: list[int]) -> None:
        for (ids, closes), held, ends in zip(sides, self.ids, self.ends):
            ends.frombytes((closes + len(held)).astype(np.int64).tobytes())
            held.frombytes(ids.tobytes())
        self.known.update(zip(pieces, range(len(self.same), len(self.same) + len(pieces))))
        self.same.extend(same)

    def chunks(self, text: str) -> Iterator[str]:
        """`` `` + ``text`` in parts of about CHUNK characters, cut where no token reaches over."""
        text, at = " " + text, 0
        while self.cuts and len(text) - at > CHUNK and (cut := BORDER.search(text, at + CHUNK)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def tokens(self, chunks: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Ids of both sides of all chunks in a row, where each chunk starts, and which are whole."""
        pieces, counts = [], []
        for chunk in chunks:
            found = PIECES.findall(chunk) if self.cuts else [chunk]
            if sum(map(len, found)) != len(chunk):
                found = [chunk]
            pieces += found
            counts.append(len(found))
        if len(self.known) > REMEMBERED:
            self._forget()
        if new := [p for p in dict.fromkeys(pieces) if p not in self.known]:
            self._learn(new)
        known = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        met = np.bincount(known, minlength=len(self.met))
        met[: len(self.met)] += self.met
        self.met = met
        starts = np.append(0, np.cumsum(counts))
        whole = np.minimum.reduceat(np.frombuffer(self.same, np.int8)[known], starts[:-1]).astype(bool)
        known, counts = known[np.repeat(whole, counts)], np.where(whole, counts, 0)
        starts = np.append(0, np.cumsum(counts))
        ids, firsts = [], []
        for held, ends in zip(self.ids, self.ends):
            ends = np.frombuffer(ends, np.int64)
            low, sizes = ends[known], ends[known + 1] - ends[known]
            total = np.append(0, np.cumsum(sizes))
            ids.append(np.frombuffer(held, np.int32)[np.repeat(low - total[:-1], sizes) + np.arange(total[-1])])
            firsts.append(total[starts])
        return tuple(ids), tuple(firsts), whole

    def aligned(self, chunks: list[str]):
        """Groups and links of all chunks; both sides have a common end at every border of them.

        Returns per chunk whether it is the same on both sides, the counts of COUNTS and the
        text of its groups with `;` after each; and all links, as (chunk, a, b) in three arrays.
        """
        ids, firsts, whole = self.tokens(chunks)
        ends = [np.cumsum(lengths[i]) for lengths, i in zip(self.lengths, ids)]
        sizes = [np.diff(f) for f in firsts]
        closes = [np.zeros(len(i), bool) for i in ids]  # tokens whose end is common
        a_drives = sizes[0] <= sizes[1]
        linked = [[], []]
        for short, drives in ((0, a_drives), (1, ~a_drives)):
            long = 1 - short
            mine = np.flatnonzero(np.repeat(drives, sizes[short]))
            rank = gallop(ends[short][mine], ends[long])
            met = ends[long][rank] == ends[short][mine]
            closes[short][mine[met]] = True
            closes[long][rank[met]] = True
            # From behind the end of the token before, or the first of its chunk, up to its own.
            low = np.append(0, rank[:-1] + met[:-1])[: len(mine)]
            opens = np.flatnonzero(drives & (sizes[short] > 0))
            low[np.searchsorted(mine, firsts[short][opens])] = firsts[long][opens]
            n = rank - low + 1
            over = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            linked[short].append(np.repeat(mine, n))
            linked[long].append(over)
        left, right = (np.concatenate(x) for x in linked)
        chunk = np.repeat(np.arange(len(chunks)), sizes[0])[left]
        n_links = np.bincount(chunk, minlength=len(chunks))
        before = [np.append(0, np.cumsum(c)) for c in closes]
        n_groups = before[0][firsts[0][1:]] - before[0][firsts[0][:-1]]

        # Group by group the ids of the first side, then those of the second.
        marks = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        group_ends = [np.append(0, np.flatnonzero(c) + 1) for c in closes]
        marks[np.arange(len(ids[0])) + group_ends[1][before[0][:-1]]] = 2 * ids[0] + closes[0]
        marks[np.arange(len(ids[1])) + group_ends[0][before[1][:-1] + 1]] = 2 * len(self.bytes_a) + 2 * ids[1] + closes[1]
        cuts = (firsts[0] + firsts[1]).tolist()
        marks = marks.tolist()
        texts = [b"".join(map(self.written.__getitem__, marks[low:high])) for low, high in zip(cuts, cuts[1:])]
        return whole, np.stack([*sizes, n_groups, n_links], 1), texts, (chunk, ids[0][left], ids[1][right])


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _distinct_links(owner: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | None, wide: tuple[int, int]):
    """Links as (owner, a, b) in order, each once, with how often it was there."""
    key = (owner * wide[0] + a) * wide[1] + b
    if n is None:
        key, n = np.unique(key, return_counts=True)
    else:
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
    return key // (wide[0] * wide[1]), key // wide[1] % wide[0], key % wide[1], n


def _documents(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        wide = (len(pair.bytes_a), len(pair.bytes_b))
        for batch in batches:
            for part in slices(batch, "text"):
                yield _rows(pair, wide, part)

    return run


def _rows(pair: Pair, wide: tuple[int, int], part: pa.RecordBatch) -> pa.RecordBatch:
    n = part.num_rows
    whole, counts = np.ones(n, bool), np.zeros((n, len(COUNTS)), np.int64)
    hashes, links = [None] * n, [(np.zeros(0, np.int64),) * 4]

    def take(owners: list[int], chunks: list[str]) -> None:
        same, numbers, texts, (chunk, a, b) = pair.aligned(chunks)
        at = np.array(owners)
        np.logical_and.at(whole, at, same)
        np.add.at(counts, at, numbers)
        for i, text in zip(owners, texts):
            if hashes[i] is None:
                hashes[i] = hashlib.sha256(text[:-1])
            else:
                hashes[i].update(b";" + text[:-1])
        links.append(_distinct_links(at[chunk], a.astype(np.int64), b, None, wide))

    owners, chunks, held = [], [], 0
    for i, text in enumerate(part.column(part.schema.get_field_index("text")).to_pylist()):
        for chunk in pair.chunks(text) if text else ():
            owners.append(i)
            chunks.append(chunk)
            held += len(chunk)
            if held >= 2 * CHUNK:
                take(owners, chunks)
                owners, chunks, held = [], [], 0
    if chunks:
        take(owners, chunks)
    owner, a, b, times = (np.concatenate(x) for x in zip(*links))
    if len(links) > 2:
        owner, a, b, times = _distinct_links(owner, a, b, times, wide)
    kept = whole[owner]
    owner, a, b, times = owner[kept], a[kept], b[kept], times[kept]
    counts[~whole] = 0
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int32)) for x in (a, b, times)], fields=list(LINKS.value_type)
    )
    digests = [h.hexdigest() if h and ok else "" for h, ok in zip(hashes, whole)]
    return pa.RecordBatch.from_arrays(
        [
            part.column(part.schema.get_field_index("row")),
            part.column(part.schema.get_field_index("doc_id")),
            *(pa.array(c) for c in counts.T),
            pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets), entries, type=LINKS),
        ],
        names=["row", "doc_id", *COUNTS, "groups_sha256", "links"],
    )


def _weighed(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Links with the count of their pair."""
    if fits_broadcast(counts, SMALL_PAIRS):
        return links.join(F.broadcast(counts), ["a", "b"])
    # Pairs in many documents are few: fewer than SMALL_PAIRS have more than this share of
    # all. They are sent out; a rarer pair is one key of a shuffle with few rows.
    most = counts.agg(F.sum("docs")).first()[0] // SMALL_PAIRS
    common = F.broadcast(counts.filter(F.col("docs") > most))
    rare = links.join(common, ["a", "b"], "left_anti").join(counts.filter(F.col("docs") <= most), ["a", "b"])
    return links.join(common, ["a", "b"]).unionByName(rare)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Documents (``row``, ``doc_id``, counts, ``groups_sha256``, ``links``) and pairs.

    ``links`` has every pair of ids that overlap somewhere in the document, and how often;
    the pairs are ``a``, ``b``, ``docs`` (rows of ``docs`` that hold it) and ``best``: whether
    no other pair of that ``a`` is in more documents. See :func:`weighed` for odd rows.
    """
    texts = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(
        texts.mapInArrow(
            _documents(path_a, path_b),
            types(
                texts, "row", "doc_id", **dict.fromkeys(COUNTS, "bigint"), groups_sha256="string",
                links="array<struct<a:int,b:int,n:int>>",
            ),
        )
    )
    counts = stored(
        rows.select(F.explode("links").alias("link")).groupBy("link.a", "link.b").agg(F.count("*").alias("docs"))
    )
    best = counts.groupBy("a").agg(F.max("docs").alias("_most"))  # a row per id of the vocabulary
    pairs = counts.join(small(best), "a").select("a", "b", "docs", (F.col("docs") == F.col("_most")).alias("best"))
    return rows, stored(pairs)


def weighed(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): how the tokens of two files align.

    ``path_a`` is a byte-level vocabulary of the tokenizers library, ``path_b`` a model of
    the sentencepiece library. Columns: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair is in the most documents of all pairs of its first id),
    ``count_sum`` (over links, the documents that hold the pair) and ``groups_sha256``.

    A text that is null, empty or not the same in the bytes of both sides has no tokens:
    zeros and an empty ``groups_sha256``. Texts of any length are aligned whole, in parts
    that no token reaches over. Repeated rows are documents each. Other columns are ignored;
    an empty table gives an empty result.
    """
    rows, pairs = aligned(docs, path_a, path_b)
    links = rows.select("row", F.explode("links").alias("link")).select("row", "link.*")
    sums = (
        _weighed(links, pairs)
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("docs")).alias("count_sum"),
        )
    )
    out = rows.drop("links").join(small(stored(sums)), "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", *COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
