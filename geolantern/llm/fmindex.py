"""An FM-index over a wavelet matrix, searched for many patterns at a time.

The text is the concatenation of segments (arrays of 64-bit word hashes) with a separator after each.
Suffixes are sorted only as deep as patterns are long: intervals of patterns up to that length are exact.
Bits are packed 64 to a word with a count directory, so the index takes about a bit per word and level.
"""

from __future__ import annotations

import numpy as np


class FMIndex:
    """Segments and how often each counts; intervals are counted by those weights."""

    def __init__(self, segments: list[np.ndarray], weights, depth: int):
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        hashes = np.concatenate(segments) if len(segments) else np.zeros(0, np.uint64)
        self.alphabet, symbols = np.unique(hashes, return_inverse=True)
        self.sigma = len(self.alphabet) + 1
        n = len(hashes) + len(sizes)
        self.ends = np.cumsum(sizes + 1) - 1  # of each segment: where its separator is
        self.starts = self.ends - sizes
        self.text = np.zeros(n, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[self.ends] = False
        self.text[inside] = symbols.ravel() + 1
        order = self._sorted(depth)
        of = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.weight = np.concatenate([[0], np.cumsum(np.asarray(weights, dtype=np.int64)[of[order]])])
        self._matrix(self.text[order - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=self.sigma))])[:-1]
        self.n = n

    def _sorted(self, depth: int):
        """Suffix order to at least ``depth`` symbols, by prefix doubling."""
        n = len(self.text)
        bits = max(1, int(self.sigma).bit_length())
        packed, known = self.text.astype(np.uint64), 1
        while (known + 1) * bits < 64:
            packed = packed << np.uint64(bits)
            packed[:n - known] |= self.text[known:].astype(np.uint64)
            known += 1
        order = np.argsort(packed)
        while True:
            key = packed[order]
            rank = np.zeros(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            if known >= depth or rank[order[-1]] == n - 1:
                return order
            packed = rank.astype(np.uint64) << np.uint64(32)
            if known < n:
                packed[:n - known] |= (rank[known:] + 1).astype(np.uint64)
            known *= 2
            order = np.argsort(packed)

    def _matrix(self, bwt):
        self.levels = max(1, int(self.sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        base = np.zeros(self.sigma, dtype=np.int64)
        every = np.arange(self.sigma)
        for level in reversed(range(self.levels)):
            bit = (bwt >> level & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1])
            self.zeros.append(len(bit) - int(bit.sum()))
            base = self._down(len(self.bits) - 1, every >> level & 1, base)
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.base = base

    def _down(self, level, bit, at):
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.counts[level][word] + np.bitwise_count(self.bits[level][word] & below)
        return np.where(bit == 1, self.zeros[level] + ones, at - ones)

    def step(self, symbol, low, high):
        """Intervals of the patterns one symbol longer to the left."""
        at = np.concatenate([low, high])
        both = np.concatenate([symbol, symbol])
        for i, level in enumerate(reversed(range(self.levels))):
            at = self._down(i, both >> level & 1, at)
        at += self.first[both] - self.base[both]
        return at[:len(low)], at[len(low):]

    def _leftwards(self, end, stop, least):
        """From text position ``end`` leftwards to ``stop``: the first position at which the match counts less
        than ``least``, or stop - 1. An array per input; all patterns move together."""
        failed = stop - 1
        live = np.arange(len(end))
        at = end.copy()
        low = np.zeros(len(end), dtype=np.int64)
        high = np.full(len(end), self.n, dtype=np.int64)
        while len(live):
            low, high = self.step(self.text[at], low, high)
            fits = self.weight[high] - self.weight[low] >= least
            failed[live[~fits]] = at[~fits]
            go = fits & (at > stop[live])
            live, at, low, high = live[go], at[go] - 1, low[go], high[go]
        return failed

    def repeated(self, window: int, least: int = 2):
        """Per segment an integer whose bit i tells that the window at word i counts at least ``least``.

        First the longest match that ends a segment is taken: its windows all repeat. The windows before
        it are searched from the left, each from its end backwards; where a match breaks off, no window
        with that place repeats, and the search goes on behind it.
        """
        mask = np.zeros(len(self.starts), dtype=np.int64)
        broke = self._leftwards(self.ends - 1, self.starts, least)
        final = self.ends - window  # the start of a segment's last window
        for i in range(int((final - self.starts).max(initial=-1)) + 1):
            at = self.starts + i
            mask |= ((at <= final) & (at > broke)).astype(np.int64) << i
        live = np.flatnonzero(broke >= self.starts)
        at, last = self.starts[live], np.minimum(broke, final)[live]
        live, at, last = (x[at <= last] for x in (live, at, last))
        while len(live):
            failed = self._leftwards(at + window - 1, at, least)
            found = failed < at
            mask[live[found]] |= np.int64(1) << (at[found] - self.starts[live[found]])
            at = np.where(found, at + 1, failed + 1)
            on = at <= last
            live, at, last = live[on], at[on], last[on]
        return mask
