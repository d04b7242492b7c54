"""Kernels over many values at once: what one value's windows, chunks and hashes take in numpy calls, a batch takes together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..options import Options
from . import codec, codes
from .constants import MULTIHASH_BLAKE3, SCHEME, Composite, Content, Main, Plain
from .hashing import blake3, xxh32_slices
from .sketches import chunk_features, dct, minhash_groups, pack_minhashes
from .text import collapse, interleave, sliding_window, utf16_length

#: Characters, and rows with bits of their own, that are worked on together.
_CHARACTERS = 1 << 19
_ROWS = 256


def _parts(sizes: Sequence[int], most: int):
    """Slices of neighbours whose sizes add up to about most."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most or i == len(sizes) - 1:
            yield slice(a, i + 1)
            a, total = i + 1, 0


def hashed(messages: Sequence[bytes]) -> list[bytes]:
    """BLAKE3 of each, a few MB at a time."""
    out: list[bytes] = []
    for part in _parts([len(m) for m in messages], 4 << 20):
        out += blake3(messages[part])
    return out


def text_hashes(texts: Sequence[str], options: Options) -> list[bytes]:
    """soft_hash_text of each text, as it is."""
    out: list[bytes] = []
    width = options.text_ngram_size
    for part in _parts([len(t) + 1 for t in texts], _CHARACTERS):
        rows = [t.encode("utf-8", "replace") for t in texts[part]]
        data = np.frombuffer(b"".join(rows), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in rows])
        begin = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        stop = np.searchsorted(begin[:-1], ends)  # behind each text's last character
        count = np.diff(stop, prepend=0)
        windows = np.maximum(1, count - width + 1)
        first = np.cumsum(windows) - windows
        at = np.repeat(stop - count - first, windows) + np.arange(windows.sum())
        start = begin[at]
        features = xxh32_slices(data, start, begin[np.minimum(at + width, np.repeat(stop, windows))] - start)
        out += [x.tobytes() for x in pack_minhashes(minhash_groups(features, first))]
    return out


def data_hashes(data: Sequence[bytes], options: Options) -> list[bytes]:
    """soft_hash_data of each."""
    out: list[bytes] = []
    for part in _parts([len(d) + 1 for d in data], 16 << 20):
        features = [chunk_features(d, options.data_avg_chunk_size) for d in data[part]]
        size = np.array([len(f) for f in features])
        out += [x.tobytes() for x in pack_minhashes(minhash_groups(np.concatenate(features), np.cumsum(size) - size))]
    return out


def gram_hashes(texts: Sequence[str], width: int) -> list[bytes]:
    """SimHash of the hashes of each text's windows; equal windows are hashed once."""
    out: list[bytes] = []
    for part in _parts([len(t) + _ROWS for t in texts], _ROWS * 2 * _ROWS):
        grams = [sliding_window(t, width) for t in texts[part]]
        number = {g: i for i, g in enumerate(dict.fromkeys(g for row in grams for g in row))}
        bits = np.unpackbits(np.frombuffer(b"".join(hashed([g.encode("utf-8", "replace") for g in number])), dtype=np.uint8).reshape(-1, 32), axis=1)
        size = np.array([len(row) for row in grams])
        sums = np.add.reduceat(bits[[number[g] for row in grams for g in row]], np.cumsum(size) - size, axis=0, dtype=np.int32)
        out += [x.tobytes() for x in np.packbits(2 * sums >= size[:, None], axis=1)]
    return out


def meta_codes(rows: Sequence[tuple], options: Options) -> list[dict]:
    """meta_code of each (name, description, meta, bits)."""
    parts = [codes.meta_parts(*(row[:3] + (None,) * (3 - len(row))), options) for row in rows]
    own = gram_hashes([collapse(p.name) for p in parts], options.meta_ngram_size_text)
    extra = {i: p for i, p in enumerate(parts) if p.extra}
    more: dict[int, bytes] = {}
    for as_json, width in ((False, options.meta_ngram_size_text), (True, options.meta_ngram_size_bytes)):
        at = [i for i, p in extra.items() if p.extra_is_json == as_json]
        more |= zip(at, gram_hashes([extra[i].extra if as_json else collapse(extra[i].extra) for i in at], width), strict=True)
    payloads = hashed([p.payload.encode("utf-8", "replace") for p in parts])
    out = []
    for i, (p, row) in enumerate(zip(parts, rows, strict=True)):
        digest = own[i] if i not in more else b"".join(interleave([own[i][k : k + 4] for k in range(0, 16, 4)], [more[i][k : k + 4] for k in range(0, 16, 4)]))
        bits = (row[3] if len(row) > 3 else None) or options.meta_bits
        out.append({"code": SCHEME + codec.unit(Main.META, Plain.NONE, 0, bits, digest), "metahash": MULTIHASH_BLAKE3 + payloads[i].hex(), "name": p.name, "description": p.description, "meta": p.shown, "version": 0})
    return out


def text_codes(rows: Sequence[tuple], options: Options) -> list[dict]:
    """text_code of each (text, bits)."""
    texts = [collapse(r[0]) for r in rows]
    return [{"code": SCHEME + codec.unit(Main.CONTENT, Content.TEXT, 0, (r[1] if len(r) > 1 else None) or options.text_bits, d), "characters": utf16_length(t)} for r, t, d in zip(rows, texts, text_hashes(texts, options), strict=True)]


def data_codes(rows: Sequence[tuple], options: Options) -> list[dict]:
    """data_code of each (data, bits)."""
    return [{"code": SCHEME + codec.unit(Main.DATA, Plain.NONE, 0, (r[1] if len(r) > 1 else None) or options.data_bits, d)} for r, d in zip(rows, data_hashes([r[0] for r in rows], options), strict=True)]


def instance_codes(rows: Sequence[tuple], options: Options) -> list[dict]:
    """instance_code of each (data, bits)."""
    return [codes.instance_result(d, len(r[0]), (r[1] if len(r) > 1 else None) or options.instance_bits) for r, d in zip(rows, hashed([r[0] for r in rows]), strict=True)]


def image_hashes(pixels: Sequence, bits: int) -> list[bytes]:
    """soft_hash_image of each square of 1024 grey values."""
    out: list[bytes] = []
    for part in _parts([1] * len(pixels), _ROWS):
        square = np.array([np.asarray(p, dtype=np.float64).reshape(32, 32) for p in pixels[part]])
        both = dct(np.ascontiguousarray(dct(square).transpose(0, 2, 1))).transpose(0, 2, 1)
        found = []
        for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))[: -(-bits // 64)]:
            low = both[:, y : y + 8, x : x + 8].reshape(len(square), 64)
            found.append(np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1))
        out += [x.tobytes() for x in np.concatenate(found, axis=1)]
    return out


def image_codes(rows: Sequence[tuple], options: Options) -> list[dict]:
    """image_code of each (pixels, bits); rows of one number of bits together."""
    wanted = [(r[1] if len(r) > 1 else None) or options.image_bits for r in rows]
    if any(b > 256 for b in wanted):
        raise ValueError("at most 256 bits")
    out: list[dict] = [{}] * len(rows)
    for bits in set(wanted):
        at = [i for i, b in enumerate(wanted) if b == bits]
        for i, d in zip(at, image_hashes([rows[i][0] for i in at], bits), strict=True):
            out[i] = {"code": SCHEME + codec.unit(Main.CONTENT, Content.IMAGE, 0, bits, d)}
    return out


def text_asset_codes(rows: Sequence[tuple], options: Options) -> list[str]:
    """The composite of a text asset of each (name, text): of the name, the text, and the text's UTF-8 bytes."""
    names = [codes.meta_parts(r[0], None, None, options).name for r in rows]
    data = [r[1].encode("utf-8", "replace") for r in rows]
    units = (gram_hashes([collapse(n) for n in names], options.meta_ngram_size_text), text_hashes([collapse(r[1]) for r in rows], options), data_hashes(data, options), hashed(data))
    head = codec.header(Main.ISCC, Composite.TEXT, 0, codec.units_field([Main.META, Main.CONTENT]))
    return [SCHEME + codec.base32(head + b"".join(u[:8] for u in row)) for row in zip(*units, strict=True)]
