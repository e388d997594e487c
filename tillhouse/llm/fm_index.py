"""A compressed full-text index over word sequences, searched backwards.

Texts are arrays of symbols. The index keeps the Burrows-Wheeler transform of all texts in
a wavelet matrix: one packed bit row per bit of a symbol, with a count per 64 bits.
"""

from __future__ import annotations

import numpy as np


class BitRow:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(len(bits) // 64 + 1, "<u8")
        packed.view(np.uint8)[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.packed = packed
        ones = np.bitwise_count(packed).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.packed[word] & below)


class WaveletMatrix:
    """Counts of a symbol in prefixes of a sequence."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.shifts = range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1)
        self.rows, self.zeros = [], []
        for shift in self.shifts:
            ones = (symbols >> shift & 1).astype(bool)
            self.rows.append(BitRow(ones))
            self.zeros.append(int(len(ones) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.first = np.zeros(n_symbols, np.int64)
        self.first = self.count(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def count(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``at`` entries."""
        wanted = symbols
        for shift, row, zeros in zip(self.shifts, self.rows, self.zeros):
            ones = row.ones(at)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at - self.first[wanted]


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffixes in order, by doubling; and the rank of each by its first ``depth`` symbols.

    ``depth`` is a power of two. The rank is None if shorter prefixes all differ.
    """
    n = len(symbols)
    rank, reach, kept = symbols.astype(np.int64), 1, None
    while True:
        if reach == depth:
            kept = rank
        following = np.zeros(n, np.int64)
        following[: max(n - reach, 0)] = rank[reach:] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key)
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        rank, reach = fresh, 2 * reach
        if rank[order[-1]] == n - 1:
            if kept is None and reach == depth:
                kept = rank
            return order, kept


class FMIndex:
    """Index of several texts, each with a number; built to look for windows of a fixed length.

    ``hashes`` are the symbols of all texts in a row, ``first`` where each starts (and the
    end), ``numbers`` their numbers.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, numbers: np.ndarray, window: int):
        self.window = window
        self.words, ids = np.unique(hashes, return_inverse=True)
        n_texts, lengths = len(first) - 1, np.diff(first)
        # A separator follows each text. For sorting they all differ, so that no match
        # reaches over them; in the transform they are one symbol, 0.
        owner = np.repeat(np.arange(n_texts), lengths + 1)
        place = np.arange(len(hashes)) + np.repeat(np.arange(n_texts), lengths)
        sorting = np.zeros(len(owner), np.int64)
        sorting[first[1:] + np.arange(n_texts)] = np.arange(n_texts)
        sorting[place] = n_texts + ids
        symbols = np.zeros(len(owner), np.int64)
        symbols[place] = ids + 1

        depth = 1 << (window.bit_length() - 1)
        order, rank = suffix_order(sorting, depth)
        transform = symbols[order - 1]
        self.size = len(order)
        self.matrix = WaveletMatrix(transform, len(self.words) + 1)
        counts = np.bincount(symbols, minlength=len(self.words) + 1)
        self.start = np.cumsum(counts) - counts
        # Neighbours in suffix order whose first ``window`` symbols agree are of one class.
        same = np.zeros(self.size, bool)
        if rank is not None:
            rest = window - depth
            reaches = order + rest < self.size
            a, b = order[1:], order[:-1]
            both = reaches[1:] & reaches[:-1]
            later = np.minimum(order + rest, self.size - 1)
            same[1:] = both & (rank[a] == rank[b]) & (rank[later[1:]] == rank[later[:-1]])
        self.class_start = np.flatnonzero(~same)
        self.class_end = np.append(self.class_start[1:], self.size)
        self.class_of = np.cumsum(~same) - 1
        self.least = np.minimum.reduceat(numbers[owner[order]], self.class_start)

    def step(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word, known to the index, in front."""
        symbol = np.searchsorted(self.words, words) + 1
        found = self.matrix.count(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.start[symbol]
        return start + found[: len(words)], start + found[len(words) :]

    def least_numbers(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window of texts that are in the index: the least number of a text that has it.

        The texts are streamed against the index from their last word to their first, all of
        them a word at a time. Once a match is longer than the window it is cut to it: its
        interval widens to the class of its first ``window`` words. So its length is the
        matching statistic of each word, capped at the window. Returns the numbers of all
        windows in a row and where those of each text start.
        """
        lengths = np.diff(first)
        windows = np.concatenate([[0], np.cumsum(np.maximum(lengths - self.window + 1, 0))])
        out = np.zeros(windows[-1], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends, sizes, slots = first[1:][order], lengths[order], windows[:-1][order]
        low = np.zeros(len(order), np.int64)
        high = np.full(len(order), self.size, np.int64)
        for back in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            active = int(np.searchsorted(-sizes, -back, side="right"))
            low, high = self.step(hashes[ends[:active] - back], low[:active], high[:active])
            if back >= self.window:
                known = self.class_of[low]
                low, high = self.class_start[known], self.class_end[known]
                out[slots[:active] + sizes[:active] - back] = self.least[known]
        return out, windows
