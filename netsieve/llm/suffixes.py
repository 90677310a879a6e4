"""Suffix order, common prefixes and the arrays that follow from them, on numpy arrays."""

from __future__ import annotations

import numpy as np


def suffix_ranks(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Rank of each suffix of `symbols`, by prefix doubling; with `depth`, suffixes alike in that many symbols at least
    may share a rank, that of the first of them. The end sorts before every symbol."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = _number(symbols[order], order, n)
    length = 1
    unsettled = _shared(ranks, order)
    while len(unsettled) and (depth is None or length < depth):
        after = unsettled + length
        following = np.where(after < n, ranks[np.minimum(after, n - 1)] + 1, 0)
        key = ranks[unsettled] * np.int64(n + 1) + following
        by = np.argsort(key, kind="stable")
        unsettled, key = unsettled[by], key[by]
        # Groups stay where they are in the order; inside them the new runs follow each other.
        group = key // (n + 1)
        at = np.arange(len(key))
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        runs = np.concatenate([[True], key[1:] != key[:-1]])
        first_of_group = at[starts][np.cumsum(starts) - 1]
        first_of_run = at[runs][np.cumsum(runs) - 1]
        ranks[unsettled] = group + first_of_run - first_of_group
        alone = runs & np.concatenate([runs[1:], [True]])
        unsettled = unsettled[~alone]
        length *= 2
    return ranks


def _number(ordered: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    ranks = np.empty(n, np.int64)
    if n:
        runs = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        ranks[order] = np.flatnonzero(runs)[np.cumsum(runs) - 1]
    return ranks


def _shared(ranks: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Positions whose rank is not theirs alone, in order."""
    if not len(order):
        return order
    ordered = ranks[order]
    same = ordered[1:] == ordered[:-1]
    return order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]


def prefix_classes(symbols: np.ndarray, length: int) -> np.ndarray:
    """A number for each suffix, ordered as the suffixes are by their first `length` symbols and equal where those are."""
    half = 1 << (length.bit_length() - 1)
    if half == length:
        return suffix_ranks(symbols, length)
    # Two overlapping halves order the whole: where the first are alike, so is the start of the second.
    ranks = suffix_ranks(symbols, half)
    n = len(symbols)
    after = np.arange(n) + (length - half)
    second = np.where(after < n, ranks[np.minimum(after, n - 1)] + 1, 0)
    key = ranks * np.int64(n + 1) + second
    order = np.argsort(key, kind="stable")
    return _number(key[order], order, n)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1.

    All places jump at once: what lies between a place and the one it points to is larger than itself, so a place that
    points to a larger value may point to where that one points.
    """
    n = len(values)
    to = np.arange(-1, n - 1)
    padded = np.append(values, np.iinfo(values.dtype).min)  # for -1
    open_ = np.flatnonzero(padded[to] >= values)
    while len(open_):
        to[open_] = to[to[open_]]
        open_ = open_[padded[to[open_]] >= values[open_]]
    return to


def repeated_starts(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each position: whether `length` symbols from it also start at an earlier one, and at a later one.

    The longest previous factor of a position is the longer of its common prefixes with the nearest smaller positions
    on either side of it in suffix order. Only whether it reaches `length` matters here, so common prefixes are told by
    the classes of equal prefixes. A position is repeated later exactly if it is such a neighbour for another: within
    a class, the place next to its smallest position has that as its nearest smaller one.
    """
    classes = prefix_classes(symbols, length)
    order = np.argsort(classes, kind="stable")
    ordered = classes[order]
    n = len(symbols)
    before = previous_smaller(order)
    after = n - 1 - previous_smaller(order[::-1])[::-1]  # n if there is none
    earlier, later = np.zeros(n, bool), np.zeros(n, bool)
    for side in (before, np.where(after < n, after, -1)):
        has = np.flatnonzero(side >= 0)
        has = has[ordered[side[has]] == ordered[has]]
        earlier[order[has]] = True
        later[order[side[has]]] = True
    return earlier, later
