"""Sorted string tables of token ids, keyed by document id.

One file::

    data blocks   entries of about BLOCK bytes, zstd-compressed; an entry is
                  varint shared key bytes, varint other key bytes, varint value bytes,
                  the other key bytes, the value (ids as little-endian unsigned 32-bit integers)
    index         for each block: its first key (length-prefixed), offset, stored bytes
    bloom filter  bits, with HASHES probes for each key
    footer        offsets and sizes of index and filter, number of entries and ids, magic

Keys are 8 bytes, big-endian with the sign bit turned, so that byte order is numeric order; a row
without an id has the empty key, which comes first.  Equal keys stand next to each other.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

MAGIC = b"TOKSST01"
BLOCK = 64 << 10
HASHES = 7
BITS_A_KEY = 10
_FOOTER = struct.Struct("<QQQQQQ8s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Takes entries in key order; memory holds one block, the index and the keys' hashes."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.entries = self.ids = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        if self.entries and key < self.keys[-1]:
            raise ValueError("keys must come in order")
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(ids) // 4
        if len(self.block) >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, *self._put(self.zstd.compress(bytes(self.block)))))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, BITS_A_KEY * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, dtype=np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        places = (*self._put(index), *self._put(np.packbits(bloom).tobytes()))
        self._put(_FOOTER.pack(*places, self.entries, self.ids, MAGIC))


class Reader:
    """Lookups of one key, or all entries in order; source is a seekable binary stream."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, magic = _FOOTER.unpack(self._read(end - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        self.bloom = self._read(bloom_at, bloom_size)
        data, at, self.index = self._read(index_at, index_size), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            self.index.append((key, offset, size))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = zstandard.ZstdDecompressor().decompress(self._read(*self.index[k][1:])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key: none, one, or more for repeated keys."""
        key = key_of(doc_id)
        bits = 8 * len(self.bloom)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, bits)):
            return []
        firsts = [k for k, _, _ in self.index]
        at, out = max(0, bisect.bisect_left(firsts, key) - 1), []
        while at < len(firsts) and firsts[at] <= key:
            out += [np.frombuffer(v, dtype="<u4") for k, v in self._block(at) if k == key]
            at += 1
        return out
