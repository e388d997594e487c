"""Byte-level BPE as a monoid: halves are encoded alone and joined at their border.

Method: a text is halved until a part is short. Parts are joined by splitting again a
window around the border, from far enough left that the pieces before it cannot depend on
what follows, to a place right of the border where the new split meets the old one again;
the window grows until it does. Long pieces are encoded the same way on their bytes: two
token lists are joined by encoding the bytes of a few tokens around the border anew, and
more of them until the outermost tokens come out unchanged. Then every two neighbours are
tokens that stay apart when encoded together, and a list in which this holds throughout is
the encoding of the whole. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.common import slices, types

LEAF_CHARS = 2048  # of text that is split at once
LEAF_BYTES = 16  # of a piece that is merged at once
LEAF_TOKENS = 4096  # that are decoded at once
# Pieces whose tokens a worker remembers; it forgets them all beyond that.
REMEMBERED = 200_000
NEVER = 1 << 62
# Letters below U+0250 apart from the two ordinal signs, and texts of them and ASCII without
# the separators that only some libraries count as white space. In such texts the classes
# of the standard library and of the pattern are the same; all others take the general form.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIMPLE = re.compile(f"[\x00-\x1b\x20-\x7e{LETTERS}]*").fullmatch


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: lines of base64 text and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """Tokens of a short byte string: merge the pair of least rank, the leftmost first."""
    parts = [data[i : i + 1] for i in range(len(data))]
    pairs = [ranks.get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
    while pairs and (least := min(pairs)) != NEVER:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
    return [ranks[p] for p in parts]


def simple_form(pattern: str) -> str:
    """The pattern with its classes spelled out for texts of ``SIMPLE`` characters."""
    return pattern.replace(r"\s\p{L}\p{N}", r"\s" + LETTERS + "0-9").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")


class Remembered(dict):
    """Packed tokens of pieces met so far; a piece is encoded when it is first asked for."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.codec.tokens(piece), np.int32).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 4 * LEAF_BYTES:
            self[piece] = packed
        return packed


class Codec:
    """Encoder and decoder over one rank table and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.general = regex.compile(pattern).findall
        self.simple = re.compile(simple_form(pattern)).findall
        self.remembered = Remembered(self)
        # Bytes of all tokens in a row, for decoding many at once.
        ids = range(max(self.bytes_of, default=-1) + 1)
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in ids], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.row = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in ids), np.uint8)

    def split(self, text: str) -> list[str]:
        """Matches of the pattern; the standard library is several times as fast where its classes agree."""
        return self.simple(text) if SIMPLE(text) else self.general(text)

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern in a text, by halves."""
        if len(text) <= LEAF_CHARS:
            return self.split(text)
        middle = len(text) // 2
        return self.join_pieces(self.pieces(text[:middle]), self.pieces(text[middle:]))

    def join_pieces(self, a: list[str], b: list[str]) -> list[str]:
        """Split of two texts in a row from the split of each.

        The split goes from left to right and a match looks at its own characters, the one
        after them and the first three from its start. A match that starts three and ends
        two characters before the end of the left text is therefore final. A new match that
        ends two characters before the end of the window is final as well, and where its
        end is also the end of a match of the right text, all later ones are the same.
        """
        if not a or not b:
            return a or b
        keep, tail = len(a), 0
        while keep and (tail < 3 or (tail - 2 < 3 and len(a[keep - 1]) + tail < 3)):
            keep -= 1
            tail += len(a[keep])
        left = "".join(a[keep:])
        take = 4
        while True:
            window = left + "".join(b[:take])
            new = self.split(window)
            whole = take >= len(b)
            if whole:
                return a[:keep] + new
            ends, at = {}, len(left)
            for i, piece in enumerate(b[:take]):
                at += len(piece)
                ends[at] = i + 1
            at = 0
            for i, piece in enumerate(new):
                at += len(piece)
                if at > len(window) - 2:
                    break
                if at in ends:
                    return a[:keep] + new[: i + 1] + b[ends[at] :]
            take *= 2

    def tokens(self, piece: str) -> list[int]:
        """Tokens of one match; a match that is a token as a whole is that token."""
        data = piece.encode()
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encode_bytes(data)

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return merged(self.ranks, data)
        middle = len(data) // 2
        return self.join_tokens(self.encode_bytes(data[:middle]), self.encode_bytes(data[middle:]))

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of two byte strings in a row from the encoding of each."""
        reach_a = reach_b = 2
        while True:
            reach_a, reach_b = min(reach_a, len(a)), min(reach_b, len(b))
            data = b"".join(self.bytes_of[t] for t in chain(a[len(a) - reach_a :], b[:reach_b]))
            # A long window is encoded by halves too, unless it is all there is.
            if len(data) > 16 * LEAF_BYTES and (reach_a < len(a) or reach_b < len(b)):
                new = self.encode_bytes(data)
            else:
                new = merged(self.ranks, data)
            left_holds = reach_a == len(a) or new[0] == a[len(a) - reach_a]
            right_holds = reach_b == len(b) or new[-1] == b[reach_b - 1]
            if left_holds and right_holds:
                return a[: len(a) - reach_a] + new + b[reach_b:]
            reach_a, reach_b = reach_a * (1 if left_holds else 2), reach_b * (1 if right_holds else 2)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.remembered.__getitem__, self.pieces(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > LEAF_TOKENS:
            middle = len(ids) // 2
            return self.decode(ids[:middle]) + self.decode(ids[middle:])
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.lengths) and self.lengths[ids].min()):
            raise ValueError("an id outside the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        return self.row[np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()


def _codecs(rows: DataFrame, path: str, pattern: str) -> Callable[[], Codec]:
    """The rank table is read once and shared; its size is that of the vocabulary."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    return lambda: Codec(shared.value, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``docs`` (``doc_id``, ``text``).

    Special tokens are ordinary text. A null or empty text has no ids. Other columns are
    ignored, repeated rows encoded each, an empty table gives an empty one.
    """
    codec_of = _codecs(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [codec.encode(text) for text in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, types(docs, "doc_id", ids="array<int>"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with the bytes the ids stand for as ``decoded``.

    Null ids stand for nothing. An id outside the vocabulary is an error.
    """
    codec_of = _codecs(encoded, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                decoded = [codec.decode(np.asarray(ids.values if ids.is_valid else [], np.int64)) for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, types(encoded, "doc_id", "ids", decoded="binary"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every document: its ids, their number, SHA-256 of ids and decoded bytes."""
    return decode(encode(docs, path, pattern), path, pattern).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
