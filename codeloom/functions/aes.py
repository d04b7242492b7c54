"""AES-256 in counter mode, only as the generator of a fixed table."""

from __future__ import annotations


def _times(a: int, b: int) -> int:
    """Product in GF(2**8) modulo x**8 + x**4 + x**3 + x + 1."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1 ^ 0x11B) if a & 0x80 else a << 1
        b >>= 1
    return out


def _sbox() -> list[int]:
    inverse = [0] * 256
    for a in range(1, 256):
        inverse[a] = next(b for b in range(1, 256) if _times(a, b) == 1) if not inverse[a] else inverse[a]
        inverse[inverse[a]] = a
    out = []
    for a in inverse:
        x = a
        for k in range(1, 5):
            x ^= (a << k | a >> (8 - k)) & 0xFF
        out.append(x ^ 0x63)
    return out


def keystream(key: bytes, n: int) -> bytes:
    box, rounds = _sbox(), 14
    words = [list(key[i : i + 4]) for i in range(0, 32, 4)]
    factor = 1
    for i in range(8, 4 * (rounds + 1)):
        w = list(words[-1])
        if i % 8 == 0:
            w = [box[x] for x in w[1:] + w[:1]]
            w[0] ^= factor
            factor = _times(factor, 2)
        elif i % 8 == 4:
            w = [box[x] for x in w]
        words.append([a ^ b for a, b in zip(words[i - 8], w, strict=True)])
    keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(rounds + 1)]
    out = b""
    for counter in range(-(-n // 16)):
        state = [a ^ b for a, b in zip(counter.to_bytes(16, "big"), keys[0], strict=True)]
        for r in range(1, rounds + 1):
            state = [box[state[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < rounds:
                state = [_times(state[4 * (i // 4) + i % 4], 2) ^ _times(state[4 * (i // 4) + (i + 1) % 4], 3) ^ state[4 * (i // 4) + (i + 2) % 4] ^ state[4 * (i // 4) + (i + 3) % 4] for i in range(16)]
            state = [a ^ b for a, b in zip(state, keys[r], strict=True)]
        out += bytes(state)
    return out[:n]
