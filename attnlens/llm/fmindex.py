"""FM-index over integer sequences, in numpy.

The Burrows-Wheeler transform of the text sits in a wavelet matrix; ``count`` searches patterns
backwards through its ranks, all patterns at once, and ``locate`` walks from each found row to the
next sampled suffix position.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; after the first round only undecided suffixes are sorted again."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length()) if n else 1
    first = max(1, 62 // (bits + 1))
    key = np.zeros(n, np.int64)
    for k in range(first):
        key <<= bits + 1
        key[: max(0, n - k)] += text[k:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    width = first
    while True:
        sizes = np.bincount(rank, minlength=n)[rank]
        open_ = np.flatnonzero(sizes > 1)
        if not len(open_):
            break
        ahead = np.zeros(len(open_), np.int64)
        inside = open_ + width < n
        ahead[inside] = rank[open_[inside] + width] + 1
        by = np.lexsort((ahead, rank[open_]))
        group, second = rank[open_][by], ahead[by]
        new_group = np.r_[True, group[1:] != group[:-1]]
        fresh = new_group | np.r_[True, second[1:] != second[:-1]]
        index = np.arange(len(by))
        offset = index - np.maximum.accumulate(np.where(new_group, index, 0))
        rank[open_[by]] = group + np.maximum.accumulate(np.where(fresh, index, 0)) - index + offset
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Rank of any symbol in any prefix, by one bit vector for each bit of the symbols."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros, self.words, self.blocks = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.r_[packed, np.zeros(8 - len(packed) % 8, np.uint8)].view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.r_[values[~bit], values[bit]]

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at.copy()
        for i in range(self.levels):
            one = (symbols >> (self.levels - 1 - i) & 1).astype(bool)
            a, b = self._ones(i, low), self._ones(i, high)
            low, high = np.where(one, self.zeros[i] + a, low - a), np.where(one, self.zeros[i] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        symbol, low, place = np.zeros_like(at), np.zeros_like(at), at.copy()
        for i in range(self.levels):
            one = (self.words[i][place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(i, low), self._ones(i, place)
            low, place = np.where(one, self.zeros[i] + a, low - a), np.where(one, self.zeros[i] + b, place - b)
            symbol = symbol << 1 | one
        return symbol, place - low


class FMIndex:
    """Counts and places of patterns in ``text`` (non-negative integers)."""

    def __init__(self, text: np.ndarray) -> None:
        shifted = np.r_[np.asarray(text, np.int64) + 1, 0]
        self.size = len(shifted)
        order = suffix_array(shifted)
        bwt = shifted[order - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(bwt))]
        self.matrix = WaveletMatrix(bwt)
        sampled = order % SAMPLE == 0
        self.marks = sampled
        self.mark_rank = np.cumsum(sampled) - sampled
        self.samples = order[sampled]

    def count(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern; patterns: one a row."""
        n, length = patterns.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        live = np.arange(n)
        for k in range(length - 1, -1, -1):
            symbol = patterns[live, k].astype(np.int64) + 1
            known = symbol < len(self.before) - 1
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live] = self.before[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.matrix.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix."""
        rows, out = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            at = rows[open_]
            hit = self.marks[at]
            out[open_[hit]] = self.samples[self.mark_rank[at[hit]]] + steps
            open_ = open_[~hit]
            symbol, rank = self.matrix.access(rows[open_])
            rows[open_] = self.before[symbol] + rank
            steps += 1
        return out
