"""Sort keys for text: base letters, then accents, then case; ``ñ`` has its own place after ``n``.

The keys are strings, so sorting stays in the JVM.  They are made in Arrow batches: the built-in functions that
could make them work sign by sign on objects, ten times slower.  Letters fold as their canonical
decomposition says; text without a Latin base weighs its own code points.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks in the order in which they break ties between equal base letters.
MARKS = [0x301, 0x300, 0x302, 0x303, 0x308, 0x30A, 0x327, None, 0x30C, 0x306, 0x304, 0x328, 0x307, 0x30B]
#: Letters that do not decompose: base and rank; strokes share a rank, and so do ligatures.
WHOLE = {"ø": ("o", 8), "ð": ("d", 8), "đ": ("d", 8), "ł": ("l", 8), "ħ": ("h", 8), "ŧ": ("t", 8), "æ": ("a", 20), "œ": ("o", 20), "ß": ("s", 20), "ÿ": ("y", 1)}
_LAST = "\U0010ffff"


def _letters() -> dict[str, tuple[str, int]]:
    """Accented Latin letters, small and capital, with their base letter and rank."""
    out = dict(WHOLE)
    for code in range(0xC0, 0x180):
        c = chr(code)
        if c in out or c.lower() == "ñ":
            continue
        if c.lower() in out and len(c.lower()) == 1:
            out[c] = out[c.lower()]
            continue
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0].isascii() and ord(parts[1]) in MARKS:
            out[c] = (parts[0].lower(), MARKS.index(ord(parts[1])) + 1)
    return out


LETTERS = _letters()
_CAPITALS = "".join(map(chr, range(65, 91)))
_FROM = "".join(LETTERS) + _CAPITALS + "Ñ"
_TO = "".join(base for base, _ in LETTERS.values()) + _CAPITALS.lower() + "ñ"


class _Signs(dict):
    """Code points to the sign of a key, by a rule for those not seen yet."""

    def __init__(self, known: dict[str, str], rule):
        super().__init__({ord(k): v for k, v in known.items()})
        self.rule = rule

    def __missing__(self, code: int) -> str:
        self[code] = out = self.rule(chr(code))
        return out


_BASES = str.maketrans({a: "n" + _LAST if b == "ñ" else b for a, b in zip(_FROM + "ñ", _TO + "ñ")})
_CASE = bytes(49 if 65 <= c <= 90 else 48 for c in range(256))


_NAMES = ("primary", "secondary", "tertiary")


def _keys_of(text: pa.Array) -> pa.Array:
    """The keys of a batch.  One text at a time is a Python string, as these take up to four bytes a sign.

    Texts of one primary key have as many signs, so the least sign need not be kept at the end of the others.
    """
    accents = _Signs({c: chr(1 + rank) for c, (_, rank) in LETTERS.items()}, lambda c: "\u0001")
    case = _Signs({}, lambda c: "1" if unicodedata.category(c) == "Lu" else "0")

    def keys(t: str) -> tuple[str, str, str]:
        if t.isascii():
            return t.lower(), "", t.encode().translate(_CASE).decode().rstrip("0")
        second, third = t.translate(accents), t.translate(case)
        # A text with the last sign itself may have the primary key of one with ñ, and other lengths.
        return (t.translate(_BASES), second, third) if _LAST in t else (t.translate(_BASES), second.rstrip("\u0001"), third.rstrip("0"))

    data, ends = [bytearray() for _ in _NAMES], np.zeros((len(_NAMES), len(text) + 1), np.int32)
    for row, item in enumerate(text, 1):
        if item.is_valid:
            for part, key in zip(data, keys(item.as_py())):
                part += key.encode()
        ends[:, row] = [len(part) for part in data]
    valid = pa.array(np.asarray(text.is_valid()), pa.bool_()).buffers()[1]
    columns = [pa.Array.from_buffers(pa.string(), len(text), [valid, pa.py_buffer(e), pa.py_buffer(bytes_)]) for e, bytes_ in zip(ends, data)]
    return pa.StructArray.from_arrays(columns, list(_NAMES))


def unicode_keys(text: Column) -> list[Column]:
    """The three keys by which ``text`` is sorted."""
    keys = F.arrow_udf(_keys_of, ", ".join(f"{n} string" for n in _NAMES))(text)
    return [keys.getField(name) for name in _NAMES]


def sort_keys(text: Column, collation: str = "unicode") -> list[Column]:
    """Keys for a collation; binary is the byte order of UTF-8."""
    return [text] if collation == "binary" else unicode_keys(text)


def python_key(text: str) -> tuple:
    """The same order for Python's ``sorted``."""
    fold = dict(zip(_FROM, _TO))
    return ([(ord(b) << 2) + (b == "ñ") * (1 - ((ord("ñ") - ord("n")) << 2)) for b in (fold.get(c, c) for c in text)], [LETTERS.get(c, ("", 0))[1] for c in text], [c.isupper() for c in text])
