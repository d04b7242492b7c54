"""k-way merging with a tree of losers: one comparison a level for each item that comes out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class LoserTree:
    """Merges sorted iterables of (key, ...) tuples; equal items come in the order of their iterables."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.sources = [iter(r) for r in runs]
        self.heads = [next(s, None) for s in self.sources]
        k = len(self.heads)
        self.size = 1
        while self.size < max(1, k):
            self.size *= 2
        self.heads += [None] * (self.size - k)
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple]:
        while (item := self.heads[self.winner]) is not None:
            yield item
            w = self.winner
            self.heads[w] = next(self.sources[w], None)
            node = (w + self.size) // 2
            while node:
                if self._before(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w
