"""Similarity-preserving sketches: SimHash, MinHash, DCT, winner-take-all, and content-defined chunks."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np

from .constants import FRAME_PAIRS, GEAR, MINHASH_A, MINHASH_B, MINHASH_PRIME
from .hashing import xxh32_slices

try:
    import xxhash
except ImportError:  # long inputs then go through numpy, one by one
    xxhash = None


def simhash(digests: Sequence[bytes]) -> bytes:
    """Bit by bit what at least half of the digests have; as long as they are."""
    if not len(digests):
        raise ValueError("no digests")
    bits = np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(len(digests), -1), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) >= len(digests)).tobytes()


_A, _B = np.array(MINHASH_A, dtype=np.uint64)[:, None], np.array(MINHASH_B, dtype=np.uint64)[:, None]
_PRIME = np.uint64(MINHASH_PRIME)


_AT_ONCE = 1 << 14


def minhash_groups(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least values (32 bits) under the 64 permutations of each group of features: a row for each of the places where groups begin (ascending; none is empty)."""
    out = np.full((len(first), 64), 0xFFFFFFFF, dtype=np.uint32)
    bounds, turn = np.r_[first, len(features)], np.uint64(61)
    for a in range(0, len(features), _AT_ONCE):  # so much stays in a processor's cache
        f = np.asarray(features[a : a + _AT_ONCE], dtype=np.uint64)
        h, t = np.empty_like(f), np.empty_like(f)
        lo, hi = np.searchsorted(bounds, a, side="right") - 1, np.searchsorted(bounds, a + len(f), side="left")
        starts = np.maximum(bounds[lo:hi] - a, 0)
        for k in range(64):
            np.multiply(f, _A[k, 0], out=h)
            h += _B[k, 0]
            np.right_shift(h, turn, out=t)
            h &= _PRIME
            h += t
            if h.max() >= _PRIME:
                h[h >= _PRIME] -= _PRIME
            np.minimum(out[lo:hi, k], np.minimum.reduceat(h.astype(np.uint32), starts), out=out[lo:hi, k])
    return out


def minhash(features: np.ndarray) -> np.ndarray:
    """Least values (32 bits) of the features under the 64 permutations."""
    if not len(features):
        raise ValueError("no features")
    return minhash_groups(np.asarray(features, dtype=np.uint64), np.zeros(1, dtype=np.int64))[0].astype(np.uint64)


def pack_minhashes(values: np.ndarray) -> np.ndarray:
    """Digests of 256 bits, as rows of bytes, of rows of least values."""
    planes = [(values >> np.uint32(k)) & np.uint32(1) for k in range(4)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def pack_minhash(values: np.ndarray, bits: int = 4) -> bytes:
    """The lowest bits of all values: first bit 0 of each, then bit 1 and so on."""
    values = np.asarray(values, dtype=np.uint64)
    return np.packbits(np.concatenate([(values >> np.uint64(k)) & np.uint64(1) for k in range(bits)]).astype(np.uint8)).tobytes()


def minhash_64(features: np.ndarray) -> bytes:
    return pack_minhash(minhash(features), 1)


def minhash_256(features: np.ndarray) -> bytes:
    return pack_minhash(minhash(features), 4)


def dct(values: np.ndarray) -> np.ndarray:
    """Unnormalised DCT-II along the last axis, whose length is a power of two: B. G. Lee's recursion of 1984, in the form of Nayuki's public note on fast DCTs, whose rounding the format's codes follow."""
    n = values.shape[-1]
    if n == 1:
        return values
    if n == 0 or n % 2:
        raise ValueError("length must be a power of two")
    front, back = values[..., : n // 2], values[..., : n // 2 - 1 : -1]
    even = dct(front + back)
    odd = dct((front - back) / (np.cos((np.arange(n // 2) + 0.5) * math.pi / n) * 2.0))
    out = np.empty_like(values, dtype=np.float64)
    out[..., 0::2] = even
    out[..., 1:-1:2] = odd[..., :-1] + odd[..., 1:]
    out[..., -1] = odd[..., -1]
    return out


_PAIRS = np.array(FRAME_PAIRS)


def winner_take_all(vector: np.ndarray, bits: int) -> bytes:
    """For each pair of places, whether the second value is larger."""
    pairs = _PAIRS[:bits]
    won = np.asarray(vector)[pairs[:, 1]] > np.asarray(vector)[pairs[:, 0]]
    return np.packbits(won).tobytes().ljust(-(-bits // 8), b"\0")


def divide(n: int, values: Sequence) -> list:
    """n slices of ceil(len / n) values; the last ones may be short or empty."""
    step = -(-len(values) // n)
    return [values[i * step : (i + 1) * step] for i in range(n)]


class ChunkRule:
    """Where chunks may end: sizes, and masks by which a rolling hash marks an end before and after the centre."""

    def __init__(self, average: int):
        self.least, self.most = average // 4, average * 8
        self.centre = average - (self.least + -(-self.least // 2))
        bits = round(math.log2(average))
        self.strict, self.loose = (1 << bits + 1) - 1, (1 << bits - 1) - 1


_GEAR = np.array(GEAR, dtype=np.uint64) << np.uint64(32)
#: Bytes after which a hash doesn't tell any more where it began, but for a carry.
_REACH = 64
_SEGMENT = 1 << 15


class _LikelyEnds:
    """Places where the rolling hash of a long run of bytes marks an end, and those where fixed point can't tell.

    The recurrence h -> h // 2 + g(byte) is the whole part of the sum of g over all bytes so far, each
    halved once for each byte behind it.  Six doublings give 64 terms of it with 32 binary places,
    of which less than 16 units of the last are lost; so the whole part is sure unless the fraction is
    that close to 1, or (for terms from before a chunk's start, which shouldn't count) to 0.
    """

    def __init__(self, data: np.ndarray, rule: ChunkRule):
        strict, loose, unsure = [], [], []
        for a in range(0, len(data), _SEGMENT):
            low = max(0, a - _REACH)
            v = _GEAR[data[low : a + _SEGMENT]]
            for s in (1, 2, 4, 8, 16, 32):
                more = v[:-s] >> np.uint64(s) if len(v) > s else v[:0]
                v[s:] += more
            v = v[a - low :]
            part = v & np.uint64(0xFFFFFFFF)
            doubt = (part >= np.uint64((1 << 32) - 16)) | (part < np.uint64(2))
            at = np.flatnonzero(((v >> np.uint64(32)) & np.uint64(rule.loose) == 0) | doubt)
            loose.append(at + a)
            strict.append(at[((v[at] >> np.uint64(32)) & np.uint64(rule.strict) == 0) | doubt[at]] + a)
            unsure.append(np.flatnonzero(doubt) + a)
        self.strict, self.loose = (np.concatenate(x).tolist() for x in (strict, loose))
        self.unsure = set(np.concatenate(unsure).tolist())

    def first(self, low: int, middle: int, high: int) -> int | None:
        """The first place from low on that is marked: strictly below middle, loosely below high."""
        for places, a, b in ((self.strict, low, middle), (self.loose, max(low, middle), high)):
            k = bisect_left(places, a)
            if k < len(places) and places[k] < b:
                return places[k]
        return None


def _scanned(data: bytes, at: int, i: int, stop: int, pattern: int, rule: ChunkRule) -> tuple[int | None, int]:
    """Byte by byte from place i of the chunk at ``at`` to stop: the end found, and the hash."""
    gear = GEAR
    for b in data[at + i : at + stop]:
        pattern = (pattern >> 1) + gear[b]
        i += 1
        if not pattern & (rule.strict if i <= rule.centre else rule.loose):
            return i, pattern
    return None, pattern


def chunk_ends(data: bytes, average: int = 1024, utf32: bool = False) -> list[int]:
    """Ends of the content-defined chunks of data; of no data, one empty chunk.

    The hash is halved before each byte's value is added, so values shift out after 32 bytes, but
    carries make it depend on where it began; it runs from the chunk's least size on.
    """
    if not data:
        return [0]
    rule, ends, at, n = ChunkRule(average), [], 0, len(data)
    likely = _LikelyEnds(np.frombuffer(data, dtype=np.uint8), rule) if n > rule.least + _REACH else None
    while at < n:
        size = min(n - at, rule.most)
        warm = min(size, rule.least + _REACH)
        end, pattern = _scanned(data, at, rule.least, warm, 0, rule)
        if end is None and warm < size:
            place = likely.first(at + warm, at + min(rule.centre, size), at + size)
            if place in likely.unsure:
                end, _ = _scanned(data, at, warm, size, pattern, rule)
            elif place is not None:
                end = place + 1 - at
        step = end if end is not None else max(size, 0)
        if utf32:
            step = max(4, step - step % 4)
        at = min(n, at + step)
        ends.append(at)
    return ends


def chunk_features(data: bytes, average: int = 1024) -> np.ndarray:
    """xxHash32 of each chunk."""
    ends = chunk_ends(data, average)
    if xxhash is not None:
        view = memoryview(data)
        return np.array([xxhash.xxh32_intdigest(view[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], dtype=np.uint32)
    ends = np.array(ends)
    start = np.r_[0, ends[:-1]]
    return xxh32_slices(np.frombuffer(data, dtype=np.uint8), start, ends - start)
