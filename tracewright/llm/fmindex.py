"""A compressed full-text index over word sequences, searched backward in numpy batches.

The Burrows-Wheeler transform is kept as one sorted array of ``symbol * n + position``: a backward step of an interval is two
binary searches in it. The document of each suffix is kept beside it for locating.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.r_[0, np.cumsum(sorted_[1:] != sorted_[:-1])]
        rank = new
        if rank.max() == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """Index of documents, each an array of symbols >= 1."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) + 1 for d in docs])
        self.n = int(sizes.sum())
        text = np.zeros(self.n, np.int64)
        ends = np.cumsum(sizes)
        for d, e in zip(docs, ends, strict=True):
            text[e - 1 - len(d) : e - 1] = d
        sa = suffix_array(text)
        doc = np.repeat(np.arange(len(docs)), sizes)
        self.docs = doc[sa].astype(np.int32)
        self.places = (sa - (ends - sizes)[doc[sa]]).astype(np.int32)
        self.keys = np.sort(text[sa - 1] * self.n + np.arange(self.n))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with ``symbol`` followed by those of the given intervals."""
        base = symbol * self.n
        return np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)

    def matches(self, queries: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of ``length`` symbols of concatenated queries, as ``(end, lo, hi)``; ends are positions in ``queries``.

        ``starts`` holds the first position of each position's query; symbols under 1 match nothing.
        """
        end = np.flatnonzero((queries > 0) & (np.arange(len(queries)) - starts >= length - 1))
        return self.search(queries, end, np.full(len(end), length, np.int64))

    def search(self, queries: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pieces of ``length`` symbols that end at the given positions, those that occur, as ``(end, lo, hi)``."""
        lo, hi, found = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64), np.ones(len(end), bool)
        for back in range(int(length.max(initial=0))):
            go = np.flatnonzero(found & (length > back))
            symbol = queries[end[go] - back]
            lo[go], hi[go] = self.step(symbol, lo[go], hi[go])
            found[go] = (hi[go] > lo[go]) & (symbol > 0)
        return end[found], lo[found], hi[found]

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals: the number of the interval and the row of the index of every occurrence."""
        n = hi - lo
        return np.repeat(np.arange(len(n)), n), np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
