"""Comparison of codes, and content addresses."""

from __future__ import annotations

import hashlib

from . import codec
from .constants import CID_HEADER, CID_MOST_BYTES, Main


def hamming(a: bytes, b: bytes) -> int:
    if len(a) != len(b):
        raise ValueError(f"digests of {len(a)} and {len(b)} bytes")
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def comparable(a: str, b: str) -> tuple[bytes, bytes]:
    """Bodies of two codes of one kind."""
    x, y = codec.decode(a), codec.decode(b)
    if any(c.main == Main.ID and c.version == 1 for c in (x, y)):
        raise ValueError("time identifiers have no similarity")
    if x[:3] != y[:3]:
        raise ValueError(f"headers differ: {x[:3]}, {y[:3]}")
    return x.body, y.body


def distance(a: str, b: str) -> int:
    """Bits that differ."""
    return hamming(*comparable(a, b))


def similarity(a: str, b: str) -> int:
    """Percent of bits that agree, rounded down."""
    x, y = comparable(a, b)
    n = 8 * len(x)
    return (n - hamming(x, y)) * 100 // n


def compare(a: str, b: str) -> dict[str, int | bool]:
    """Unit by unit: how many bits differ, and whether instances are the same."""
    left, right = ([codec.parse(codec.from_base32(u)) for u in codec.decompose(codec.normalize(c))] for c in (a, b))
    if any(c.main == Main.ID and c.version == 1 for c in (*left, *right)):
        return {"id_match": left[0] == right[0]}
    out: dict[str, int | bool] = {}
    for x in left:
        for y in right:
            if x[:3] != y[:3]:
                continue
            if x.main == Main.INSTANCE:
                out["instance_match"] = x.body == y.body
            else:
                out[f"{Main(x.main).name.lower()}_dist"] = hamming(x.body, y.body)
    return out


def prefix_distance(a: bytes, b: bytes) -> tuple[float, int]:
    """Share of bits that differ in the common length, and its bits; 0 if both are empty, 1 if one is."""
    n = min(len(a), len(b))
    return (hamming(a[:n], b[:n]) / (8 * n), 8 * n) if n else (float(bool(a or b)), 0)


def prefix_similarity(a: bytes, b: bytes) -> tuple[float, int]:
    share, bits = prefix_distance(a, b)
    return 1.0 - share, bits


def cid(data: bytes) -> str:
    """Content identifier (version 1, raw, SHA-256) in base16."""
    if len(data) > CID_MOST_BYTES:
        raise ValueError(f"more than {CID_MOST_BYTES} bytes")
    return "f" + (CID_HEADER + hashlib.sha256(data).digest()).hex()


def cid_to_token(text: str) -> int:
    data = bytes.fromhex(text[1:]) if text.startswith("f") else b""
    if data[:4] != CID_HEADER or len(data) != 36:
        raise ValueError("not a base16 content identifier of raw data by SHA-256")
    return int.from_bytes(data[4:], "big")


def cid_from_token(token: int) -> str:
    return "f" + (CID_HEADER + token.to_bytes(32, "big")).hex()
