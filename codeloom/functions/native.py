"""Column functions that Catalyst runs alone: no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BASE32, BASE32HEX, CANONICAL, CID_HEADER, CID_MOST_BYTES, FRAME_PAIRS, MULTIHASH_BLAKE3, PREFIXES, SCHEME, SPACES, Main

_SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]"
_BOM = "﻿"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{_SPACE_CLASS}+|{_SPACE_CLASS}+$", "")


def cut_utf8(text: Column | str, limit: int | None = None) -> Column:
    """At most limit bytes of UTF-8; U+FFFD for a character that is cut; no byte order mark in front."""
    data = F.encode(_col(text), "UTF-8")
    valid = F.make_valid_utf8((F.substring(data, 1, limit) if limit else data).cast("string"))
    return F.when(valid.startswith(_BOM), F.substring(valid, 2, 2**31 - 1)).otherwise(valid)


def trim(text: Column | str, limit: int | None = None) -> Column:
    return strip(cut_utf8(text, limit))


def remove_newlines(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), f"{_SPACE_CLASS}+", " "))


def utf16_length(text: Column | str) -> Column:
    return (F.octet_length(F.encode(_col(text), "UTF-16LE")) / 2).cast("int")


def sliding_window(text: Column | str, width: int) -> Column:
    """Array of all runs of width characters; of a shorter text, itself."""
    if width < 2:
        raise ValueError("width must be 2 or more")
    t = _col(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - width + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(width)))


def chunk_string(text: Column | str, size: int) -> Column:
    """Array of pieces of size characters, none across a line end; null if there are none."""
    if size < 1:
        raise ValueError("size must be positive")
    found = F.regexp_extract_all(_col(text), F.lit(f"([^\\n\\r\\u2028\\u2029]{{1,{size}}})"), F.lit(1))
    return F.when(F.size(found) > 0, found)


def interleave(a: Column | str, b: Column | str) -> Column:
    x, y = _col(a), _col(b)
    n = F.least(F.size(x), F.size(y))
    return F.coalesce(F.flatten(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: F.array(p, q))), F.array())


def divide(values: Column | str, n: int) -> Column:
    """Array of n slices of ceil(size / n) values."""
    v = _col(values)
    step = F.ceil(F.size(v) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(v, i * step + 1, step))


def rtrim(text: Column | str, characters: str) -> Column:
    return F.rtrim(_col(text), F.lit(characters))


def b64url_encode(text: Column | str) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(_col(text), "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def b64url_decode(text: Column | str) -> Column:
    plain = F.translate(_col(text), "-_=", "+/")
    return F.make_valid_utf8(F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")).cast("string"))


def data_url(payload: Column | str, linked: Column | bool = False) -> Column:
    kind = F.when(linked if isinstance(linked, Column) else F.lit(linked), F.lit("application/ld+json")).otherwise(F.lit("application/json"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.translate(F.base64(F.encode(_col(payload), "UTF-8")), "\r\n", ""))


def data_url_payload(url: Column | str) -> Column:
    """Text behind a data URL's first comma."""
    return b64url_decode(F.split(_col(url), ",")[1])


def base32(data: Column | str, alphabet: str = BASE32) -> Column:
    """Base32 of a binary column, without padding: five bytes at a time as a number."""
    digits = F.hex(_col(data))
    size = F.length(digits) / 2
    group = lambda g: F.conv(F.rpad(F.substring(digits, g * 10 + 1, F.lit(10)), 10, "0"), 16, 10).cast("long")
    letters = lambda n: F.concat(*(F.substring(F.lit(alphabet), F.shiftright(n, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)))
    groups = F.transform(F.sequence(F.lit(0), (F.ceil(size / 5) - 1).cast("int")), lambda g: letters(group(g)))
    return F.when(size > 0, F.substring(F.array_join(groups, ""), F.lit(1), F.ceil(size * 8 / 5).cast("int"))).when(size == 0, F.lit(""))


def base32hex(data: Column | str) -> Column:
    return base32(data, BASE32HEX)


def unit_code(main: int, sub: int, version: int, bits: int, digest: Column | str) -> Column:
    """A unit's code from the first bits of a binary digest (64 bits in steps of 32)."""
    field = bits // 32 - 1 if main != Main.ID else (bits - 64) // 8
    if not (0 <= field < 8 and max(main, sub, version) < 8):
        raise ValueError("a header of two bytes is needed")
    head = F.lit(bytes([main << 4 | sub, version << 4 | field]))
    return F.concat(F.lit(SCHEME), base32(F.concat(head, F.substring(_col(digest), 1, bits // 8))))


def time_id(microseconds: Column | str, hub: Column | int = 0, realm: int = 0) -> Column:
    """Identifier of a time and a hub; null outside of 52 and 12 bits."""
    t, h = _col(microseconds).cast("long"), (hub if isinstance(hub, Column) else F.lit(hub)).cast("long")
    number = F.shiftleft(t, 12).bitwiseOR(h)
    code = unit_code(Main.ID, realm, 1, 64, F.unhex(F.lpad(F.hex(number), 16, "0")))
    return F.when((t >= 0) & (t < 1 << 52) & (h >= 0) & (h < 4096), code)


def cid(data: Column | str) -> Column:
    """Content identifier of a binary column; null beyond the size limit."""
    d = _col(data).cast("binary")
    return F.when(F.octet_length(d) <= CID_MOST_BYTES, F.concat(F.lit("f" + CID_HEADER.hex()), F.sha2(d, 256)))


def cid_digest(text: Column | str) -> Column:
    """The 32 bytes of a content identifier (its token, as a number); null for other text."""
    t = _col(text)
    return F.when(t.rlike(f"^f{CID_HEADER.hex()}[0-9a-fA-F]{{64}}$"), F.unhex(F.substring(t, 10, 64)))


def cid_from_digest(digest: Column | str) -> Column:
    return F.concat(F.lit("f" + CID_HEADER.hex()), F.lower(F.hex(_col(digest))))


def multihash(digest: Column | str) -> Column:
    return F.concat(F.lit(MULTIHASH_BLAKE3), F.lower(F.hex(_col(digest))))


def words64(digest: Column | str, bits: int = 64) -> Column:
    """A digest as an array of 64-bit words."""
    digits = F.hex(_col(digest))
    unsigned = [F.conv(F.substring(digits, 16 * k + 1, 16), 16, -10).cast("long") for k in range(-(-bits // 64))]
    return F.array(*unsigned)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Bits that differ between two arrays of 64-bit words; null for different lengths."""
    x, y = _col(a), _col(b)
    return F.when(F.size(x) == F.size(y), F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d))


def similarity(a: Column | str, b: Column | str, bits: int = 64) -> Column:
    """Percent of bits that agree, rounded down."""
    return F.floor((bits - hamming(a, b)) * 100 / bits).cast("int")


def clean_code(code: Column | str) -> Column:
    """Without scheme, blanks and dashes (but of base64url); null for another scheme or a second colon."""
    c = strip(code)
    parts = F.transform(F.split(c, ":"), strip)
    body = F.element_at(parts, -1)
    plain = F.when((F.size(parts) == 1) & body.startswith("u"), body).otherwise(F.translate(body, "-", ""))
    return F.when((F.size(parts) == 1) | ((F.size(parts) == 2) & (F.lower(parts[0]) == SCHEME[:-1].lower())), plain)


def has_code_shape(code: Column | str) -> Column:
    """A first test that needs no decoding: canonical letters and a known prefix."""
    c = _col(code)
    return c.rlike(CANONICAL) & F.substring(c, len(SCHEME) + 1, 2).isin(*PREFIXES)


def frame_bits(sums: Column | str, bits: int = 64) -> Column:
    """Winner-take-all over an array of sums: the digest, binary."""
    v = _col(sums)
    octet = lambda k: F.concat(*(F.when(F.get(v, F.lit(b)) > F.get(v, F.lit(a)), F.lit("1")).otherwise(F.lit("0")) for a, b in FRAME_PAIRS[8 * k : 8 * k + 8]))
    return F.unhex(F.concat(*(F.lpad(F.conv(octet(k), 2, 16), 2, "0") for k in range(bits // 8))))
