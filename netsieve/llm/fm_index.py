"""FM-index of a sequence of small numbers: backward search and locating, for many phrases at once."""

from __future__ import annotations

import numpy as np

from netsieve.llm.suffixes import suffix_ranks


class WaveletTree:
    """Ranks of symbols in a sequence, one bit of the symbols per level, each level a stable partition of the last."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(levels - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            ones = np.zeros(len(bits) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.levels.append((shift, ones, len(bits) - int(ones[-1])))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for shift, ones, zeros in self.levels:
            bit = (symbols >> shift & 1).astype(bool)
            start = np.where(bit, zeros + ones[start], start - ones[start])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Over runs of symbols 1, 2, ..., separated by zeros; phrases hold no zero.

    Each zero counts as a symbol of its own, so no suffix is compared beyond its run. Suffix positions are kept for
    every `rate`-th position and every start of a run; others are reached by steps to the previous symbol, which thus
    never cross a zero.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, rate: int = 8):
        n = len(symbols)
        zeros = symbols == 0
        distinct = np.where(zeros, np.cumsum(zeros), symbols.astype(np.int64) + n)
        ranks = suffix_ranks(distinct)
        order = np.empty(n, np.int64)
        order[ranks] = np.arange(n)
        self.bwt = symbols[order - 1]  # before the first symbol stands the last: a zero
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))]).astype(np.int64)
        self.tree = WaveletTree(self.bwt, max(1, int(sigma).bit_length()))
        kept = (order % rate == 0) | (self.bwt == 0)
        self.sampled, self.positions = kept, np.where(kept, order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes, low and high, that begin with each row of `phrases`; empty if there is none."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.before[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions in the sequence at which the suffixes of these rows start."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbol = self.bwt[rows[walking]]
            rows[walking] = self.before[symbol] + self.tree.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.positions[rows] + steps
