"""Words of a batch of texts as arrays: where they stand and a 64-bit hash of each.

All texts of a batch are one byte array; a word never reaches over the border of a text.
Hashes are the same in every process and on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ByteClasses:
    inside: np.ndarray  # per byte whether it belongs to a word
    folded: np.ndarray  # and the byte it counts as


def byte_classes(separators: set[int], lower: bool = False) -> ByteClasses:
    """Words of all bytes but the separators; optionally A-Z as a-z."""
    inside, folded = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    inside[sorted(separators)] = False
    if lower:
        folded[0x41:0x5B] += 32
    return ByteClasses(inside, folded)


# Words [^\x20\x09-\x0D]+, unchanged, and words of letters and digits with A-Z lowered,
# where every byte of a non-ASCII character belongs to a word (fixed values).
BY_SPACE = byte_classes({0x20, *range(0x09, 0x0E)})
ALPHANUMERIC = byte_classes(
    {*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True
)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    first: np.ndarray  # per text the index of its first word; one more entry at the end
    start: np.ndarray  # per word its first byte
    end: np.ndarray  # and the byte after its last
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def left(self) -> np.ndarray:
        """Per word the words of its text from it to the end."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def words(data: np.ndarray, texts: np.ndarray, classes: ByteClasses) -> Words:
    """Words of the texts that start at ``texts[:-1]`` in ``data`` and end at ``texts[1:]``."""
    inside = classes.inside[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        filled = texts[:-1] < texts[1:]
        held = inside[:-1].copy()
        held[texts[:-1][filled & (texts[:-1] > 0)] - 1] = False  # the text before ends there
        opens[1:] &= ~held
        held = inside[1:].copy()
        held[texts[1:][filled & (texts[1:] < len(data))] - 1] = False
        closes[:-1] &= ~held
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(np.searchsorted(start, texts), start, end, _hashes(classes.folded[data], start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word: its eight-byte pieces, each mixed with its place, and its length.

    Mixing comes before the sum, so that no pattern of letters cancels out.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    pieces = (size + 7) >> 3
    opens = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(opens, pieces)
    at, left = np.repeat(start, pieces) + 8 * nth, np.repeat(size, pieces) - 8 * nth
    aligned = np.zeros(len(data) // 8 + 2, "<u8")
    aligned.view(np.uint8)[: len(data)] = data
    shift = (at & 7).astype(np.uint64) << np.uint64(3)
    # A shift by all 64 bits gives zero.
    piece = aligned[at >> 3] >> shift | aligned[(at >> 3) + 1] << (np.uint64(64) - shift)
    piece &= ~np.uint64(0) >> (np.uint64(64) - (np.minimum(left, 8).astype(np.uint64) << np.uint64(3)))
    place = mixed(np.arange(1, int(pieces.max()) + 1, dtype=np.uint64) * _BASE)
    return mixed(np.add.reduceat(mixed(piece ^ place[nth]), opens) + size.astype(np.uint64) * _BASE)


def same_words(data: np.ndarray, found: Words) -> np.ndarray:
    """A number per word, the same for the same bytes: hashes, made sure of byte by byte."""
    _, first, number = np.unique(found.hash, return_index=True, return_inverse=True)
    size = found.end - found.start
    like = first[number]
    if (size == size[like]).all():
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if (data[np.repeat(found.start, size) + within] == data[np.repeat(found.start[like], size) + within]).all():
            return number
    known: dict[bytes, int] = {}  # two words of one hash
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(found.start, found.end)])


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``k`` words from each word on; the last entries of a text reach beyond it."""
    factors = mixed(np.arange(seed * 64 + 1, seed * 64 + k + 2, dtype=np.uint64)) | np.uint64(1)
    out = np.full(len(hashes), factors[0], np.uint64)
    for j in range(min(k, len(out))):
        out[: len(out) - j] += hashes[j:] * factors[j + 1]
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each position on, as far as there are so many."""
    out, reach = values.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        if step >= len(out):
            break
        out[:-step] = np.minimum(out[:-step], out[step:])
        reach += step
    return out
