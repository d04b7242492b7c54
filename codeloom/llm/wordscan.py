"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a longest run of word bytes inside one text.  Words get 64-bit hashes (a polynomial over
random byte values, finished by a mixer), and windows of words get hashes made of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
_PIECE = 1 << 18
_MULT = 0x9E3779B97F4A7C15 | 5
_WORD_MULT = 0xD1342543DE82EF95
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _class(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = _class(lambda b: b != 0x20 and not 9 <= b <= 13)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
LETTERS_DIGITS = _class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, made longer as needed."""

    def __init__(self, mult: int):
        self.mult, self.inverse = mult, pow(mult, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, m in (("up", self.mult), ("down", self.inverse)):
                a = np.full(n, m, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_MULT), _Powers(_WORD_MULT)
_WORDS2 = _Powers(0xF1357AEA2E62A9C5)


@dataclass
class Words:
    """data: lower-cased or plain bytes; start, end: byte positions of words; first: word number at which each text begins, and the total."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _PIECE, side="right")))
        last = end[j - 1]
        up, down = _BYTES.get(int(last - base) + 1)
        total = np.empty(int(last - base) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUES[data[base:last]] * up[: last - base], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


def scan(texts: pa.Array, table: np.ndarray, lower: bool) -> Words:
    """Words of an Arrow array of strings; a null is a text without words."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    raw = (_LOWER if lower else _SAME)[raw] if lower else raw
    word = table[raw]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = at[:-1][at[:-1] < at[1:]]
    begins[edges] = word[edges]
    edges = at[1:][at[:-1] < at[1:]] - 1
    ends[edges] = word[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(raw, start, end, np.searchsorted(start, at), _piece_hashes(raw, start, end))


def window_hashes(hashes: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Hashes of all windows of width values, from every position on (also those that span two texts)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    out, step = np.empty(n - width + 1, dtype=np.uint64), 1 << 16
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        part = hashes[a : b + width - 1]
        up, down = (_WORDS2 if second else _WORDS).get(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[a:b] = (total[width:] - total[: b - a]) * down[: b - a]
    return mix(out + _U(width))


def slices(batch: pa.RecordBatch | pa.Table, text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive parts of at most most_bytes of text each (a longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    size = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0)
    total = np.cumsum(size.to_numpy(zero_copy_only=False) if isinstance(size, pa.Array) else size.to_numpy())
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most_bytes, side="right")))
        yield batch.slice(a, b - a)
        a = b
