"""A compressed FM-index over the words of one shard, searched for many patterns at once with numpy."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of small integers: one packed bit vector for each bit, with a count every 64 bits."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            packed = np.zeros(self.n // 64 + 1, np.uint64)
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((packed, before, self.n - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros(len(symbols), np.int64)
        places = places.copy()
        for level, (packed, before, zeros) in enumerate(self.levels):
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            for at in (low, places):
                word = at >> 6
                ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
                np.copyto(at, np.where(one, zeros + ones, at - ones))
        return places - low


class FMIndex:
    """Counts of word sequences of up to ``depth`` words in a text of segments.

    text: word numbers from 1 on, and 0 after each segment. Suffixes are sorted by their first ``depth`` words or more, which
    is all that the backward search of patterns of that length needs.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        while reach <= depth:
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            fresh = np.r_[False, key[order[1:]] != key[order[:-1]]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            reach *= 2
        self.bwt = WaveletMatrix(text[order - 1])
        self.starts = np.r_[0, np.cumsum(np.bincount(text))]

    def matches(self, text: np.ndarray, ends: np.ndarray, depth: int, least: int = 2) -> np.ndarray:
        """Matching statistics: for each place the length, up to ``depth``, of the longest sequence that ends there and
        stands at least ``least`` times in the index."""
        length = np.zeros(len(ends), np.int64)
        active = np.arange(len(ends))
        symbol = text[ends]
        low, high = self.starts[symbol], self.starts[symbol + 1]
        for step in range(1, depth + 1):
            go = high - low >= least
            active, low, high = active[go], low[go], high[go]
            length[active] = step
            if step == depth or not len(active):
                break
            symbol = text[ends[active] - step]
            inside = symbol > 0
            active, low, high, symbol = active[inside], low[inside], high[inside], symbol[inside]
            low, high = self.starts[symbol] + self.bwt.rank(symbol, low), self.starts[symbol] + self.bwt.rank(symbol, high)
        return length
