"""An FM-index over one shard's words: suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 32


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order.  0 separates runs, and the last symbol is one; each separator is a symbol of its own, ordered by place, so that no comparison goes beyond its run.

    Prefix doubling, of which each round sorts only suffixes that still tie.
    """
    n = len(symbols)
    separators = symbols == 0
    rank = symbols.astype(np.int64) + np.count_nonzero(separators)
    rank[separators] = np.arange(np.count_nonzero(separators))
    key = rank * (int(rank.max(initial=0)) + 2)
    key[:-1] += rank[1:] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    start, step = np.r_[True, key[1:] != key[:-1]][:n], 2
    while not start.all():
        rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        tied = np.flatnonzero(~(start & np.r_[start[1:], True]))
        suffix = order[tied]
        key = rank[suffix] * n + rank[suffix + step]
        by = np.argsort(key, kind="stable")
        order[tied], key = suffix[by], key[by]
        start[tied] = np.r_[True, key[1:] != key[:-1]]
        step *= 2
    return order


class _Bits:
    """Bits with the number of ones before any place: a count for each 64 bits, and the bits themselves."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit, bitorder="little")
        self.words = np.frombuffer(packed.tobytes().ljust((len(bit) // 64 + 1) * 8, b"\0"), dtype=np.uint64)
        self.before = (np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)


class WaveletMatrix:
    """Rank of any symbol below 2**bits before any place, in one lookup for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        now = symbols.astype(np.int32)
        for k in range(bits - 1, -1, -1):
            bit = ((now >> k) & 1).astype(bool)
            self.levels.append(_Bits(bit))
            self.zeros.append(len(now) - int(np.count_nonzero(bit)))
            now = np.concatenate([now[~bit], now[bit]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where, in the last level, the at-th place ends up for symbol; its rank is this less place(symbol, 0)."""
        for level in range(self.bits):
            one = self.levels[level].ones(at)
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + one, at - one)
        return at


class FMIndex:
    """symbols: 1 to size - 1, with 0 behind each run."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n = n = len(symbols)
        suffixes = suffix_array(symbols)
        self.last = symbols[suffixes - 1].astype(np.int32)
        self.wavelets = WaveletMatrix(self.last, max(1, int(size - 1).bit_length()))
        smaller = np.r_[0, np.cumsum(np.bincount(symbols, minlength=size))[:-1]]
        every = np.arange(size)
        self.shift = smaller - self.wavelets.place(every, np.zeros(size, dtype=np.int64))
        first = np.r_[True, symbols[:-1] == 0]
        kept = first[suffixes] | (suffixes % SAMPLE == 0)
        self.kept, self.sampled, self.before = kept, suffixes[kept].astype(np.int32), (np.cumsum(kept) - 1).astype(np.int32)

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.shift[symbol] + self.wavelets.place(symbol, row)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows, filled up with 0 at the end): their rows from low to below high."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for t in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > t) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - t]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next sampled row."""
        rows = rows.copy()
        steps, walking = np.zeros(len(rows), dtype=np.int64), np.flatnonzero(~self.kept[rows])
        while len(walking):
            rows[walking] = self.step(self.last[rows[walking]], rows[walking])
            steps[walking] += 1
            walking = walking[~self.kept[rows[walking]]]
        return self.sampled[self.before[rows]].astype(np.int64) + steps
