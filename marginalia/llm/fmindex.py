"""A compressed FM-index over integer sequences: a Burrows-Wheeler transform in a wavelet matrix of packed bits.

Many backward searches run side by side: each step extends all live patterns by one symbol to the left.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with counts before each 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the bits before each place are set."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


class Wavelet:
    """Counts of symbols before a place, in one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels: list[tuple[int, Bits]] = []
        for bit in range(max(1, int(kinds - 1).bit_length()) - 1, -1, -1):
            set_ = ((symbols >> bit) & 1).astype(bool)
            self.levels.append((bit, Bits(set_)))
            symbols = np.concatenate([symbols[~set_], symbols[set_]])
        self.starts = self._down(np.arange(kinds), np.zeros(kinds, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbols >> bit) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbols, at) - self.starts[symbols]


def suffixes(text: np.ndarray, kinds: int, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols (or a few more): ranks of as many symbols as a long holds, then doubling."""
    reach = max(k for k in range(1, 64) if k == 1 or (kinds + 1) ** k < 1 << 63)
    key = np.zeros(len(text), np.int64)
    for k in range(min(reach, max(1, depth))):
        key *= kinds + 1
        key[: max(0, len(text) - k)] += text[k:] + 1  # 0 stands behind the end
    while reach < depth:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:] + 1
        key = rank * (len(text) + 1) + ahead
        reach *= 2
    return np.argsort(key, kind="stable")


class FMIndex:
    """Answers how often patterns of at most ``depth`` symbols are in a text of symbols 0 to kinds - 1."""

    def __init__(self, text: np.ndarray, kinds: int, depth: int):
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))])
        self.n = len(text)
        self.wavelet = Wavelet(text[suffixes(text, kinds, depth) - 1], kinds)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front, from those of the patterns."""
        ranks = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.before[symbols] + ranks[: len(symbols)], self.before[symbols] + ranks[len(symbols) :]


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where windows of pieces of ``text`` (starts, lengths) are in the index more than once: (piece, first window, last window) of intervals.

    From an end in each piece, backward steps go on while the index has the match twice: that is the matching statistic of
    this end. If it reaches the window, all windows inside the match are repeated, and the next end is that of the
    last window which begins before the match; if it doesn't, the next end is one word before.
    """
    found = []
    piece, end = np.arange(len(starts)), lengths.copy()
    piece, end = piece[end >= window], end[end >= window]
    at, low, high = end.copy(), np.zeros(len(end), np.int64), np.full(len(end), index.n)
    while len(piece):
        to_low, to_high = index.extend(text[starts[piece] + at - 1], low, high)
        twice = to_high - to_low >= 2
        at = at - twice
        over = ~twice | (at == 0)
        low, high = np.where(over, 0, to_low), np.where(over, index.n, to_high)
        if over.any():
            long = over & (end - at >= window)
            found.append((piece[long], at[long], end[long] - window))
            next_end = np.where(long, at + window - 1, end - 1)
            end = np.where(over, next_end, end)
            at = np.where(over, next_end, at)
            live = end >= window
            piece, end, at, low, high = piece[live], end[live], at[live], low[live], high[live]
    return found
