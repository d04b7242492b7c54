"""Text normalisation, and the small string and JSON functions around it."""

from __future__ import annotations

import base64
import json
import math
import re
import unicodedata
from functools import cache

import numpy as np

from .constants import NEWLINES, SPACES

_SPACE_RUN = re.compile(f"[{re.escape(SPACES)}]+")
_NEWLINE = re.compile(f"[{re.escape(NEWLINES)}]")
_MANY_NEWLINES = re.compile("\n{3,}")


def strip(text: str) -> str:
    return text.strip(SPACES)


def cut_utf8(text: str, limit: int | None = None) -> str:
    """At most limit bytes of UTF-8, with U+FFFD for a character that is cut, and without a byte order mark in front."""
    data = text.encode("utf-8", "replace")
    if limit and limit > 0:
        data = data[:limit]
    out = data.decode("utf-8", "replace")
    return out[1:] if out.startswith("\ufeff") else out


def trim(text: str, limit: int | None = None) -> str:
    return strip(cut_utf8(text, limit))


def remove_newlines(text: str) -> str:
    """One space for each run of white space, none at the ends."""
    return _SPACE_RUN.sub(" ", text).strip(" ")


@cache
def _dropped(kinds: str) -> _Categories:
    return _Categories(kinds)


class _Categories(dict):
    """A translation table that drops characters by the first letters or whole names of their category."""

    def __init__(self, kinds: str):
        super().__init__()
        self.kinds = tuple(kinds.split())

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)).startswith(self.kinds) else code
        return self[code]


@cache
def _controls() -> dict[int, None]:
    return {c: None for c in (*range(32), *range(127, 160)) if chr(c) not in NEWLINES}


def clean(text: str) -> str:
    """NFKC, without control characters, with at most two line ends in a row, trimmed."""
    text = unicodedata.normalize("NFKC", text).translate(_controls())
    return strip(_MANY_NEWLINES.sub("\n\n", _NEWLINE.sub("\n", text)))


def collapse(text: str) -> str:
    """Only what is compared: lower case without white space, controls, marks and punctuation."""
    text = trim(unicodedata.normalize("NFD", text))
    text = _SPACE_RUN.sub("", text).lower().translate(_dropped("C M P"))
    return unicodedata.normalize("NFKC", text)


def utf16_length(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def sliding_window(text: str, width: int) -> list[str]:
    """All runs of width characters; of a shorter text, itself."""
    if width < 2:
        raise ValueError("width must be 2 or more")
    return [text[i : i + width] for i in range(max(1, len(text) - width + 1))]


def window_places(text: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text, and where the windows begin in them and how long they are."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    begin = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
    n = max(1, len(begin) - width)
    start = begin[:n]
    return data, start, begin[np.minimum(np.arange(n) + width, len(begin) - 1)] - start


def chunk_string(text: str, size: int) -> list[str] | None:
    """Pieces of size characters; no piece crosses a line end, which belongs to none.  None if there are no pieces."""
    if size < 1:
        raise ValueError("size must be positive")
    return [line[i : i + size] for line in re.split("[\n\r\u2028\u2029]", text) for i in range(0, len(line), size)] or None


def interleave(a: list | None, b: list | None) -> list:
    """a's and b's values in turn, as long as a goes."""
    return [] if a is None or b is None else [x for pair in zip(a, b, strict=False) for x in pair]


def b64url_encode(text: str) -> str:
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def b64url_decode_bytes(text: str) -> bytes:
    text = re.sub("[^A-Za-z0-9+/]", "", text.split("=")[0].translate(str.maketrans("-_", "+/")))
    return base64.b64decode(text[: len(text) - (len(text) % 4 == 1)] + "=" * (-len(text) % 4 if len(text) % 4 != 1 else 0))


def b64url_decode(text: str) -> str:
    return b64url_decode_bytes(text).decode("utf-8", "replace")


def _parse(text: str):
    def refuse(name: str):
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def is_json(text: str | None) -> bool:
    """Whether text is a JSON object or array, without top-level names that would reach prototypes."""
    try:
        value = _parse(text or "")
    except ValueError:
        return False
    return isinstance(value, list) or (isinstance(value, dict) and not {"__proto__", "constructor", "prototype"} & value.keys())


def _number(x: int | float) -> str:
    """A number as ECMAScript writes it."""
    x = float(x)
    if x == 0 or not math.isfinite(x):
        return "0" if x == 0 else "null"
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = (len(whole) if whole != "0" else -(len(part) - len(part.lstrip("0")))) + int(power or 0)
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{digits}"
    else:
        out = f"{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if point > 1 else '-'}{abs(point - 1)}"
    return f"-{out}" if x < 0 else out


def _is_index(name: str) -> bool:
    return name == "0" or (name.isascii() and name.isdigit() and name[0] != "0" and int(name) < 2**32 - 1)


def _write(value, order) -> str:
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int | float):
        return _number(value)
    if isinstance(value, list):
        return f"[{','.join(_write(x, order) for x in value)}]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(value[k], order)}" for k in order(value)) + "}"


def minify(text: str) -> str:
    """JSON without white space; names stay in order, but integers come first, ascending, as in ECMAScript objects."""
    return _write(_parse(text), lambda d: [*sorted(filter(_is_index, d), key=int), *(k for k in d if not _is_index(k))])


def canonical_json(value) -> bytes:
    """RFC 8785: names ordered by UTF-16 code units at every level."""
    return _write(value, lambda d: sorted(d, key=lambda k: k.encode("utf-16-be"))).encode()
