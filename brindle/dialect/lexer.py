"""Splits a statement into tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from brindle.errors import SqlError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<blob>[xX]'(?:[^'])*')
    |(?P<text>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |(?P<param>\?|%s|%\([A-Za-z_]\w*\)s)
    |(?P<word>[^\W\d]\w*)
    |(?P<sign><=|>=|<>|!=|[=<>(),.;*+\-/%])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    value: Any
    at: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.value.upper() in words


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            what = "an unclosed quote" if sql[at] in "'\"`" else f"an unexpected character {sql[at]!r}"
            raise SqlError(f"{what} at position {at}")
        kind, raw = m.lastgroup, m.group()
        at = m.end()
        if kind == "space":
            continue
        value: Any = raw
        if kind == "text":
            value = raw[1:-1].replace("''", "'")
        elif kind == "quoted":
            value = raw[1:-1].replace(raw[0] * 2, raw[0])
        elif kind == "blob":
            try:
                value = bytes.fromhex(raw[2:-1])
            except ValueError:
                raise SqlError(f"bad hexadecimal in {raw[:20]}") from None
        elif kind == "number":
            if re.fullmatch(r"\d+", raw):
                value = int(raw)
                if value > 1 << 63:
                    raise SqlError(f"integer {raw} is out of range")
            else:
                value = float(raw)
                if value in (float("inf"),):
                    raise SqlError(f"number {raw} is out of range")
        elif kind == "param":
            value = raw[2:-2] if raw.startswith("%(") else None
        out.append(Token(kind, value, m.start()))
    out.append(Token("end", None, len(sql)))
    return out
