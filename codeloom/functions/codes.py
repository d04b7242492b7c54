"""Generators of codes for one asset, and of the soft hashes in them.

``bits`` of 0 or None takes the option's default; more than a digest has is refused.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np

from ..options import Options
from . import codec
from .constants import FRAME_VALUES, MULTIHASH_BLAKE3, SCHEME, Content, Main, Plain
from .hashing import Blake3, blake3, xxh32, xxh32_slices
from .sketches import chunk_ends, chunk_features, dct, divide, minhash, minhash_256, pack_minhash, simhash, winner_take_all
from .text import b64url_decode, chunk_string, clean, collapse, interleave, is_json, minify, remove_newlines, sliding_window, trim, utf16_length, window_places

DEFAULTS = Options()


def _only_version_0(version: int | None) -> None:
    if version:
        raise ValueError("only version 0 is supported")


def _coded(main: int, sub: int, bits: int, digest: bytes) -> str:
    return SCHEME + codec.unit(main, sub, 0, bits, digest)


# -- metadata ---------------------------------------------------------------------------------


def multihash(text: str) -> str:
    return MULTIHASH_BLAKE3 + blake3([text.encode("utf-8", "replace")])[0].hex()


def _gram_hash(text: str, width: int) -> bytes:
    return simhash(blake3([g.encode("utf-8", "replace") for g in sliding_window(text, width)]))


def soft_hash_meta(name: str, extra: str | None = None, extra_is_json: bool = False, options: Options = DEFAULTS) -> bytes:
    """256 bits; with more than a name, 4 times 32 bits of the name's hash and of the other's in turn."""
    own = _gram_hash(collapse(name), options.meta_ngram_size_text)
    if not extra:
        return own
    more = _gram_hash(extra, options.meta_ngram_size_bytes) if extra_is_json else _gram_hash(collapse(extra), options.meta_ngram_size_text)
    return bytes.fromhex("".join(interleave(chunk_string(own[:16].hex(), 8), chunk_string(more[:16].hex(), 8))))


class MetaParts(NamedTuple):
    """What a meta code is made of: normalised name and description, the payload that is hashed, what is compared beside the name, and the metadata as shown."""

    name: str
    description: str
    payload: str
    extra: str
    extra_is_json: bool
    shown: str | None


def meta_parts(name: str, description: str | None, meta: str | None, options: Options = DEFAULTS) -> MetaParts:
    import base64

    name = trim(remove_newlines(clean(trim(name, 10 * options.meta_trim_name))), options.meta_trim_name)
    if not name:
        raise ValueError("a name is needed that isn't empty once normalised")
    description = trim(clean(trim(description or "", 10 * options.meta_trim_description)), options.meta_trim_description)
    if not meta:
        return MetaParts(name, description, trim(f"{name} {description}"), description, False, None)
    if utf16_length(meta) > options.max_meta_bytes:
        raise ValueError(f"metadata has more than {options.max_meta_bytes} characters")
    if "data:" in meta:
        payload = b64url_decode((meta.split(",") + [""])[1])
        return MetaParts(name, description, payload, payload, is_json(payload), meta)
    if not is_json(meta):
        raise ValueError("metadata must be a data URL or JSON")
    payload = minify(meta)
    kind = "application/ld+json" if "@context" in meta else "application/json"
    return MetaParts(name, description, payload, payload, True, f"data:{kind};base64,{base64.b64encode(payload.encode()).decode()}")


def meta_code(name: str, description: str | None = None, meta: str | None = None, bits: int | None = None, version: int | None = None, options: Options = DEFAULTS) -> dict:
    """Code of a name, and of a description or of metadata (JSON, or a data URL)."""
    _only_version_0(version)
    p = meta_parts(name, description, meta, options)
    digest = soft_hash_meta(p.name, p.extra, p.extra_is_json, options)
    return {"code": _coded(Main.META, Plain.NONE, bits or options.meta_bits, digest), "metahash": multihash(p.payload), "name": p.name, "description": p.description, "meta": p.shown, "version": 0}


# -- content ----------------------------------------------------------------------------------


def text_features(text: str, width: int) -> np.ndarray:
    return xxh32_slices(*window_places(text, width))


def soft_hash_text(text: str, options: Options = DEFAULTS) -> bytes:
    """256 bits of MinHash over the text's n-grams, as they are."""
    return minhash_256(text_features(text, options.text_ngram_size))


def text_code(text: str, bits: int | None = None, version: int | None = None, options: Options = DEFAULTS) -> dict:
    _only_version_0(version)
    text = collapse(text)
    return {"code": _coded(Main.CONTENT, Content.TEXT, bits or options.text_bits, soft_hash_text(text, options)), "characters": utf16_length(text)}


def soft_hash_image(pixels: Sequence[float], bits: int = 64) -> bytes:
    """From 32 x 32 grey values: low frequencies against their median, in up to four 8 x 8 squares."""
    if bits > 256:
        raise ValueError("at most 256 bits")
    square = np.asarray(pixels, dtype=np.float64).reshape(-1, 32)
    both = dct(np.ascontiguousarray(dct(square).T)).T
    out = b""
    for x, y in ((0, 0), (1, 0), (0, 1), (1, 1)):
        low = both[y : y + 8, x : x + 8].ravel()
        out += np.packbits(low > np.median(low)).tobytes()
        if 8 * len(out) >= bits:
            break
    return out


def image_code(pixels: Sequence[float], bits: int | None = None, version: int | None = None, options: Options = DEFAULTS) -> dict:
    _only_version_0(version)
    bits = bits or options.image_bits
    return {"code": _coded(Main.CONTENT, Content.IMAGE, bits, soft_hash_image(pixels, bits))}


def soft_hash_audio(features: Sequence[int], bits: int = 64) -> bytes:
    """32 bits each of all features, of their quarters in order and of their thirds by value."""
    if not len(features):
        return bytes(32)
    values = [int(x) for x in features]
    part = lambda v: simhash([(x & 0xFFFFFFFF).to_bytes(4, "big") for x in v]) if len(v) else bytes(4)
    parts = [part(values), *map(part, divide(4, values)), *map(part, divide(3, sorted(values)))]
    stop = bits // 32 if bits % 32 == 0 and 64 <= bits <= 256 else len(parts)
    return b"".join(parts[:stop])


def audio_code(features: Sequence[int], bits: int | None = None, version: int | None = None, options: Options = DEFAULTS) -> dict:
    _only_version_0(version)
    bits = bits or options.audio_bits
    return {"code": _coded(Main.CONTENT, Content.AUDIO, bits, soft_hash_audio(features, bits))}


def soft_hash_video(frames: Sequence[Sequence[int]], bits: int = 64) -> bytes:
    """Of the sum of all different frame signatures, which of two values is larger, for fixed pairs."""
    if not len(frames):
        raise ValueError("a frame signature is needed")
    distinct = {tuple(int(x) for x in f) for f in frames}
    width = len(frames[0])
    if width < FRAME_VALUES or any(len(f) != width for f in distinct):
        raise ValueError(f"frame signatures must have {FRAME_VALUES} values, and all the same number")
    return winner_take_all(np.sum(np.array(list(distinct), dtype=np.int64), axis=0), bits)


def video_code(frames: Sequence[Sequence[int]], bits: int | None = None, version: int | None = None, options: Options = DEFAULTS) -> dict:
    _only_version_0(version)
    bits = bits or options.video_bits
    return {"code": _coded(Main.CONTENT, Content.VIDEO, bits, soft_hash_video(frames, bits))}


def soft_hash_codes(codes: Sequence[bytes], bits: int = 64) -> bytes:
    """Majority of content codes' first header bytes and bodies."""
    if len(codes) < 2:
        raise ValueError("two codes at least are needed")
    parsed = [codec.parse(c) for c in codes]
    if any(c.main != Main.CONTENT for c in parsed):
        raise ValueError("only content codes can be mixed")
    if any(codec.bit_length(c.main, c.length) < bits for c in parsed):
        raise ValueError(f"a code is shorter than {bits} bits")
    return simhash([(raw[:1] + c.body[: bits // 8 - 1]).ljust(bits // 8, b"\0") for raw, c in zip(codes, parsed, strict=True)])


def mixed_code(codes: Sequence[str], bits: int | None = None, version: int | None = None, options: Options = DEFAULTS) -> dict:
    _only_version_0(version)
    bits = bits or options.mixed_bits
    digest = soft_hash_codes([codec.from_base32(codec.from_multiformat(c)) for c in codes], bits)
    return {"code": _coded(Main.CONTENT, Content.MIXED, bits, digest), "parts": list(codes)}


# -- data and instance ------------------------------------------------------------------------


def soft_hash_data(data: bytes, options: Options = DEFAULTS) -> bytes:
    return minhash_256(chunk_features(data, options.data_avg_chunk_size))


def data_code(data: bytes, bits: int | None = None, version: int | None = None, options: Options = DEFAULTS) -> dict:
    _only_version_0(version)
    return {"code": _coded(Main.DATA, Plain.NONE, bits or options.data_bits, soft_hash_data(data, options))}


class DataHasher:
    """Data code of a stream: the least values so far, and the last chunk, which more data may change."""

    def __init__(self, data: bytes = b"", options: Options = DEFAULTS):
        self.least, self.tail, self.average, self.pushed = np.full(64, 0xFFFFFFFF, dtype=np.uint64), b"", options.data_avg_chunk_size, False
        if data:
            self.push(data)

    def push(self, data: bytes) -> None:
        self.pushed = True
        data = self.tail + data
        ends = chunk_ends(data, self.average)
        if len(ends) > 1:
            stop = np.array(ends[:-1])
            start = np.r_[0, stop[:-1]]
            self.least = np.minimum(self.least, minhash(xxh32_slices(np.frombuffer(data, dtype=np.uint8), start, stop - start)))
        self.tail = data[ends[-2] if len(ends) > 1 else 0 :]

    def digest(self) -> bytes:
        if not self.pushed:
            raise ValueError("nothing was pushed")
        last = xxh32_slices(np.frombuffer(self.tail, dtype=np.uint8), np.array([0]), np.array([len(self.tail)]))
        return pack_minhash(np.minimum(self.least, minhash(last)), 4)

    def code(self, bits: int = 64) -> str:
        return codec.unit(Main.DATA, Plain.NONE, 0, bits, self.digest())

    def state(self) -> bytes:
        return bytes([self.pushed]) + self.least.astype("<u4").tobytes() + self.tail

    @classmethod
    def from_state(cls, data: bytes, options: Options = DEFAULTS) -> DataHasher:
        out = cls(options=options)
        out.pushed, out.least, out.tail = bool(data[0]), np.frombuffer(data[1:257], dtype="<u4").astype(np.uint64), data[257:]
        return out


class InstanceHasher:
    """Instance code of a stream."""

    def __init__(self, data: bytes = b""):
        self.blake3 = Blake3()
        if data:
            self.push(data)

    def push(self, data: bytes) -> None:
        self.blake3.push(data)

    @property
    def filesize(self) -> int:
        return self.blake3.size

    def digest(self) -> bytes:
        return self.blake3.digest()

    @property
    def multihash(self) -> str:
        return MULTIHASH_BLAKE3 + self.digest().hex()

    def code(self, bits: int = 64) -> str:
        return codec.unit(Main.INSTANCE, Plain.NONE, 0, bits, self.digest())


def instance_code(data: bytes, bits: int | None = None, version: int | None = None, options: Options = DEFAULTS) -> dict:
    _only_version_0(version)
    return instance_result(blake3([data])[0], len(data), bits or options.instance_bits)


def instance_result(digest: bytes, size: int, bits: int) -> dict:
    return {"code": _coded(Main.INSTANCE, Plain.NONE, bits, digest), "datahash": MULTIHASH_BLAKE3 + digest.hex(), "filesize": size}


# -- identifiers ------------------------------------------------------------------------------


class Flake:
    """Digests of 48 bits of time in milliseconds and a counter, which begins at random with each new time.

    Makers side by side get a number each (``part`` of ``parts``): it takes the counter's highest
    bits, and the counter waits for the next millisecond once it has gone through its own.
    """

    def __init__(self, random: Callable[[int], bytes] = os.urandom, part: int = 0, parts: int = 1):
        self.random, self.time, self.start, self.count = random, None, 0, 0
        self.part, self.high = part, max(0, parts - 1).bit_length()

    def digest(self, seconds: float | None = None, bits: int = 64) -> bytes:
        if not 64 <= bits <= 256 or bits % 32:
            raise ValueError("64 to 256 bits, in steps of 32")
        size = bits // 8 - 6
        own = 1 << 8 * size - self.high  # numbers of this maker in a millisecond
        if 8 * size - self.high < 1:
            raise ValueError(f"{bits} bits have no room for so many makers")
        now = int((time.time() if seconds is None else seconds) * 1000)
        if self.time is not None and self.time[1] == size and self.high:
            now = max(now, self.time[0])
        if (now, size) == self.time and self.high and self.count >= own:
            now += 1
        if (now, size) != self.time:
            self.time, self.start, self.count = (now, size), int.from_bytes(self.random(size), "big"), 0
        number = (self.start + self.count) % own | self.part * own
        self.count += 1
        return now.to_bytes(6, "big") + number.to_bytes(size, "big")


_FLAKE = Flake()


def flake_code(bits: int | None = None, seconds: float | None = None, options: Options = DEFAULTS, maker: Flake = _FLAKE) -> dict:
    bits = bits or options.flake_bits
    return {"code": _coded(Main.FLAKE, Plain.NONE, bits, maker.digest(seconds, bits))}


def time_id(microseconds: int | None = None, hub: int = 0, realm: int = 0) -> dict:
    """Identifier of a time (52 bits of microseconds) and a hub (12 bits)."""
    at = time.time_ns() // 1_000_000 * 1000 if microseconds is None else microseconds
    if not 0 <= at < 1 << 52:
        raise ValueError("time outside of 52 bits")
    if not 0 <= hub < 1 << 12:
        raise ValueError("hub outside of 12 bits")
    if realm not in (0, 1):
        raise ValueError("realm must be 0 or 1")
    return {"code": SCHEME + codec.unit(Main.ID, realm, 1, 64, (at << 12 | hub).to_bytes(8, "big"))}


def _wallet_hash(wallet: str) -> bytes:
    return hashlib.sha256(wallet.encode("ascii")).digest()[:8]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


def soft_hash_wallet_id(code: str, wallet: str, counter: int = 0) -> bytes:
    """Majority of a code's units (but for Instance, unless alone) under the wallet's hash, and the counter behind it."""
    raw = [codec.from_base32(u) for u in codec.decompose(code)]
    parsed = [codec.parse(r) for r in raw]
    if any(c.main == Main.ID for c in parsed):
        raise ValueError("an identifier can't be made of an identifier")
    only = len(raw) == 1
    digests = [(r[:1] + c.body[:7]).ljust(8, b"\0") for r, c in zip(raw, parsed, strict=True) if only or c.main != Main.INSTANCE]
    return _xor(simhash(digests), _wallet_hash(wallet)) + (codec.uvarint(counter) if counter else b"")


def wallet_id(code: str, chain: int, wallet: str, counter: int = 0) -> dict:
    digest = soft_hash_wallet_id(code, wallet, counter)
    return {"code": SCHEME + codec.unit(Main.ID, chain, 0, 8 * len(digest), digest)}


def next_wallet_id(code: str) -> str:
    """The identifier with its counter one higher (without scheme)."""
    c = codec.parse(codec.from_base32(codec.clean_code(code)))
    if c.main != Main.ID or c.version != 0:
        raise ValueError("only identifiers of version 0 have a counter")
    digest = c.body[:8] + codec.uvarint(codec.from_uvarint(c.body[8:])[0] + 1 if len(c.body) > 8 else 1)
    return codec.unit(Main.ID, c.sub, 0, 8 * len(digest), digest)


def wallet_id_simhash(code: str, wallet: str) -> str:
    """The similarity hash inside of an identifier, in hex."""
    return _xor(codec.decode(code).body[:8], _wallet_hash(wallet)).hex()
