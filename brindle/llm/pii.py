"""Personal identifiers by bootstrapped contextual extraction.

Every identifier-like string (an address with @, a telephone form, a dotted quad, a long number, a long
mixed code) is a candidate with lexical patterns: its shape with its checks, and the words before and
after it.  Candidates of strict forms are seeds (mail addresses, +-prefixed telephone numbers, valid IPv4
addresses, card numbers with a known issuer and a right check digit, codes that a word like ``token``
announces); strings that break their form's rules (long numbers with a wrong check digit, octets above
255) are counter-examples.  Then patterns and instances (distinct strings) score each other in ``ROUNDS``
rounds of joins over their graph: a pattern's confidence is the mean score of its instances, damped by
``DAMP`` unknown ones; an instance's score is the noisy-or of its patterns of at least ``CONFIDENT`` with
``SUPPORT`` good instances.  Instances of at least ``ACCEPT`` are identifiers, also where no seed rule knew them.

After each round but the last, patterns of two context words that became confident take whatever stands in their
slot, of any form: a run of tokens with digits, or one token.  What a slot takes is unknown at first.  If that is so
much that the pattern's mean score falls below ``CONFIDENT``, as where ordinary words fill the slot, the pattern is
out from then on and what it took with it.  Of the others' strings, one that stands in their slots in less than ``SHARE`` of
its occurrences is a counter-example; the rest are new instances of the slot's kind and take part in the next round.
A part of the texts is searched first: whatever number of strings puts a pattern out there does so in all texts.

Defined results: one row (``doc_id``, ``kind``, ``start``, ``end``, ``value``, ``score``, ``seed``) for each
occurrence, with character offsets in the text.  Identifiers have any length; a context word of more than
``WORD`` signs counts by the ``WORD`` that are next to the slot, as the only one on its side.  Null and empty texts
have none, very long ones theirs like any other; rows with a null or repeated ``doc_id`` give theirs each time;
patterns and instances at a threshold pass it, so ties need no order; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import BitFilter, q, table
from brindle.llm.textkit import buffers, chunks, mix
from brindle.storage import cut, drop

ROUNDS, DAMP, CONFIDENT, SUPPORT, ACCEPT, SHARE, SLICE = 3, 1.0, 0.75, 3, 0.75, 0.5, 200_000
#: One of so many rows is searched first for patterns that take too much; it changes no result.
FIRST = 32
MAIL = r"(?P<email>(?<![\w.+\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+)"
REST = (
    r"(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<phone>\+\d{1,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d.\-]))"
    r"|(?P<secret>(?<![A-Za-z0-9_\-])(?=[A-Za-z_\-]*+\d)(?=[\d_\-]*+[A-Za-z])[A-Za-z0-9_\-]{16,})"
    r"|(?P<number>(?<!\d)(?:\d{4}[ \-]){3}\d{4}(?!\d)|(?<![\d.])\d{7,}(?!\d))"
)
ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)")
ANNOUNCED = re.compile(r"(?i)(?:token|secret|key|password|passwd|pwd)\W{0,4}$")
WORD = 64
AFTER = re.compile(rf"\s*(\S{{1,{WORD}}})")
UNIT = re.compile(r"\S*\d\S*(?: \S*\d\S*)*|\S+")
SIGN, SIGNED = re.compile(r"[\d@]"), re.compile(r"\S*[\d@]\S*(?:\s\S*[\d@]\S*)*")
EDGE = "\"'`()[]{}<>=:,;.!?"
DIGIT, RUNS = re.compile("[0-9]+"), re.compile("99+")
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_INK, _DIGITS = np.ones(256, bool), np.zeros(256, bool)
_INK[[*range(9, 14), *range(28, 33)]] = False
_DIGITS[48:58] = True
_BODY = _INK.copy()
_BODY[[ord(c) for c in EDGE]] = False
LEAD = re.compile(r"[\w.\-]*(?:=|[=:][\"'])(?=\w)")
SCHEMA = "doc_id long, kind string, start int, end int, value string, seed double, patterns array<string>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def shape(value: str) -> str:
    """Runs of small letters, capitals and digits as one sign each; long codes and numbers keep their length."""
    out, last = [], ""
    for c in value:
        sign = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if sign != last:
            out.append(sign)
        last = sign
    text = "".join(out)
    return text if len(text) <= 12 else text[:4] + "~"


def checked(kind: str, value: str, before: str) -> tuple[float | None, str]:
    """(1 for a seed, 0 for a counter-example, None for unknown; the checks' results as a word)."""
    if kind == "email":
        tail = value.rsplit(".", 1)[1]
        return (1.0 if tail.isalpha() and 2 <= len(tail) <= 12 and value[0].isalnum() else None), "form"
    if kind == "ip":
        good = all(int(x) <= 255 for x in value.split("."))
        return (1.0 if good else 0.0), "octets" if good else "no octets"
    if kind == "phone":
        n = sum(c.isdigit() for c in value)
        return (1.0 if value[0] == "+" and 9 <= n <= 15 else None), f"{min(n, 16)} digits"
    if kind == "number":
        digits = re.sub(r"\D", "", value)
        if not 13 <= len(digits) <= 19:
            return None, f"{len(digits)} digits"
        good, issuer = luhn(digits), ISSUER.match(digits)
        word = f"{len(digits)} digits, {'right' if good else 'wrong'}, from {issuer.group() if issuer else digits[0]}"
        return (1.0 if good and issuer else None if good else 0.0), word
    hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", value) is not None
    return (1.0 if ANNOUNCED.search(before) and len(value) >= 20 else None), f"{'hex' if hexadecimal else 'code'} of {len(value) // 8 * 8}"


def around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The two words before and the one after a span, numbers as 9."""
    left, right = [], AFTER.match(text, end)
    at = start
    while len(left) < 2:
        while at and text[at - 1].isspace():
            at -= 1
        to = at
        while at and to - at < WORD and not text[at - 1].isspace():
            at -= 1
        if at == to:
            break
        left.insert(0, text[at:to])
        if to - at == WORD:
            break
    fold = lambda w: DIGIT.sub("9", w.lower())
    return [fold(w) for w in left], [fold(right.group(1))] if right else []


def slot_patterns(kind: str, left: list[str], right: list[str]) -> list[str]:
    """Patterns of two context words, whatever the form between them."""
    out = [f"{kind}|[{' '.join(left)}"] if len(left) == 2 else []
    return out + [f"{kind}|[{left[-1]}\t{right[0]}"] if left and right else out


def described(m: re.Match, text: str, shift: int = 0) -> tuple[str, int, int, str, float | None, list[str]]:
    """Kind, start, end, value, seed mark and patterns of a match that begins ``shift`` signs later in ``text``."""
    kind, value, start, end = m.lastgroup, m.group(), m.start() + shift, m.end() + shift
    seed, word = checked(kind, value, text[max(0, start - 64) : start])
    left, right = around(text, start, end)
    patterns = [f"{kind}|{'' if kind == 'secret' else shape(value)}|{word}", *slot_patterns(kind, left, right)]
    if left:
        patterns += [f"{kind}|<{left[-1]}", f"{kind}|<{' '.join(left)}|{word}"]
    if right:
        patterns.append(f"{kind}|>{right[0]}")
    return kind, start, end, value, seed, patterns


def found_in(text: str) -> Iterator[tuple[str, int, int, str, float | None, list[str]]]:
    """Candidates of a text: kind, start, end, value, seed mark and patterns."""
    for m in (_WITH_MAIL if "@" in text else _WITHOUT).finditer(text):
        yield described(m, text)


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and value of whatever may stand in a slot, without quotes and punctuation around it."""
    for m in UNIT.finditer(text):
        found = inside(m.group(), m.start())
        if found:
            yield found


def inside(unit: str, at: int) -> tuple[int, int, str] | None:
    """The value in a unit that starts at ``at``; None if it is all marks."""
    lead = LEAD.match(unit)
    a = lead.end() if lead else len(unit) - len(unit.lstrip(EDGE))
    value = unit[a:].rstrip(EDGE)
    return (at + a, at + a + len(value), value) if value else None


def covered(text: str, at: int) -> bool:
    """Whether a candidate of the text covers the sign at ``at``: the tokens with digits or @ around it are searched."""
    before = lambda end: max(text.rfind(x, 0, end) for x in " \n\t\r") + 1
    start = before(at)
    m = SIGNED.match(text, start)
    if not m:
        return False
    while start and SIGN.search(text, to := before(start - 1), start - 1):
        start = to
    part = text[start : m.end()]
    return any(x.start() <= at - start < x.end() for x in (_WITH_MAIL if "@" in part else _WITHOUT).finditer(part))


def uncovered(text: str, spans: list[tuple]) -> list[tuple]:
    """The spans (start, end, ...) that no candidate covers at their start."""
    return [x for x in spans if not covered(text, x[0])]


def right_of(low: str, at: int) -> str | None:
    """The word after the slot that begins at ``at``; None if that takes a closer look (digits, a lead)."""
    to = low.find(" ", at)
    unit = low[at:] if to < 0 else low[at:to]
    if "9" in unit or "=" in unit or ":" in unit:
        return None
    tail = unit[len(unit.rstrip(EDGE)) :]
    if tail or to < 0:
        return tail[:WORD]
    after = low.find(" ", to + 1)
    return low[to + 1 : after if after >= 0 else None][:WORD]


class Slots:
    """Confident patterns of two context words, and an automaton that finds their words before the slot in one pass over a text."""

    def __init__(self, confident: set[str]):
        import ahocorasick

        self.confident, self.automaton = set(confident), ahocorasick.Automaton()
        self.keys: dict[str, tuple[set[str], dict[str, set[str]]]] = {}
        for p in confident:
            kind, left, right = self._parts(p)
            two, by_right = self.keys.setdefault(left, (set(), {None: set()}))
            (by_right.setdefault(right, set()) if right else two).add(kind)
        for key, (two, by_right) in self.keys.items():
            self.automaton.add_word(key, (key[-1], two, by_right))
        if self.keys:
            self.automaton.make_automaton()

    @staticmethod
    def _parts(pattern: str) -> tuple[str, str, str]:
        """The kind, the words before the slot as they are looked for, and the one after it."""
        kind, context = pattern.split("|[", 1)
        left, _, right = context.partition("\t")
        return kind, " " + left, right

    def forget(self, pattern: str) -> None:
        """Find no more of a pattern."""
        kind, left, right = self._parts(pattern)
        two, by_right = self.keys[left]
        (by_right[right] if right else two).discard(kind)
        if right and not by_right[right]:
            del by_right[right]
        self.confident.discard(pattern)

    def found(self, text: str) -> list[tuple[int, int, str, str, list[str]]]:
        """(start, end, value, kind, patterns) of what stands in the slots of a text with single spaces between its words."""
        low = " " + text.lower()
        if len(low) != len(text) + 1:  # a few letters change their length
            low = " " + "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for sign in "012345678":
            low = low.replace(sign, "9")
        at, lost, gone = [], [0], 0  # where runs of digits became one sign, and how many signs were lost up to there
        if "99" in low:
            for m in RUNS.finditer(low):
                gone += m.end() - m.start() - 1
                at.append(m.end() - gone)
                lost.append(gone)
            low = RUNS.sub("9", low)
        out = {}
        for place, (last, two, by_right) in self.automaton.iter(low):
            if not two and len(by_right) == 1:  # forgotten
                continue
            # The context's last sign in ``low`` has the place of the sign after it in ``text``.
            end = place + lost[bisect_right(at, place + 1)]
            if end == len(text) or not (text[end] == " " or last in EDGE):
                continue
            if not two and low[place + 1 : place + 2] == " " and right_of(low, place + 2) not in by_right:
                continue
            m = UNIT.match(text, end + (text[end] == " "))
            span = m and inside(m.group(), m.start())
            if not span:
                continue
            kinds = two
            if len(by_right) > 1 and (after := AFTER.match(text, span[1])):
                kinds = two | by_right.get(DIGIT.sub("9", after.group(1).lower()), set())
            for kind in kinds:
                if (span[0], kind) not in out:
                    patterns = [p for p in slot_patterns(kind, *around(text, *span[:2])) if p in self.confident]
                    if patterns:
                        out[span[0], kind] = (*span, kind, patterns)
        return uncovered(text, list(out.values()))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(start, end, hash) of the tokens of a run of texts without punctuation around them, and of runs of tokens with digits; as ``units`` has them but for leads.

    Tokens that may have a lead are listed besides.  All is done over the bytes at once.  White space beyond
    ASCII counts as such.
    """
    n = len(data)
    if ODD_SPACE.search(memoryview(data)):
        data = data.copy()
        for m in list(ODD_SPACE.finditer(data.tobytes())):
            data[m.start() : m.end()] = 10
    start, end = tokens_of(data, offsets)
    sign = np.flatnonzero(data == 61)
    if n > 1:
        sign = np.concatenate([sign, np.flatnonzero((data[:-1] == 58) & ((data[1:] == 34) | (data[1:] == 39)))])
    leads = [(int(start[k]), int(end[k])) for k in np.unique(np.searchsorted(start, sign, "right") - 1)]
    if not len(start):
        return start, end, np.zeros(0, np.uint64), leads
    digit = np.logical_or.reduceat(_DIGITS[data], start)
    first, last = start.copy(), end.copy()
    for side, step in ((first, 1), (last, -1)):  # strip marks from the ends of those that have any
        k = np.arange(len(side))
        while len(k):
            k = k[(first[k] < last[k]) & ~_BODY[data[np.minimum(side[k] if step > 0 else side[k] - 1, n - 1)]]]
            side[k] += step
    full = last > first
    a, b = [first[full]], [last[full]]
    joined = digit[1:] & digit[:-1] & (start[1:] == end[:-1] + 1) & (data[np.minimum(end[:-1], n - 1)] == 32)
    joined[np.searchsorted(start, offsets[(offsets > start[0]) & (offsets <= start[-1])]) - 1] = False  # not over a text's edge
    head = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]]))
    tail = np.flatnonzero(joined & ~np.concatenate([joined[1:], [False]])) + 1
    start, end = np.concatenate([*a, first[head]]), np.concatenate([*b, last[tail]])
    return start, end, rough_hashes(data, start, end), leads


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of bytes that are no white space, within each text."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside_ = np.zeros(n + 2, bool)
    inside_[1:-1] = _INK[data]
    return np.flatnonzero((inside_[1:] & (~inside_[:-1] | edge))[:n]), np.flatnonzero(inside_[:-1] & (~inside_[1:] | edge))


def rough_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the length, the first and the last eight bytes of stretches: enough for a filter before strings are compared."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
    size = end - start
    short = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
    cut_ = np.where(short == 64, np.uint64(0), np.uint64(64) - short)
    first = np.where(short == 0, np.uint64(0), (eight[start + 8] << cut_) >> cut_)
    last = np.where(short == 0, np.uint64(0), eight[end] >> cut_)
    return mix(mix(first ^ mix(size.astype(np.uint64))) ^ last * np.uint64(0x9E3779B97F4A7C15))


def value_hashes(values: DataFrame) -> BitFilter:
    """A filter of the hashes of written ``values`` (value), as ``spans`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(0))
            yield pa.record_batch([pa.array(rough_hashes(data, at[:-1], at[1:]).view(np.int64))], ["h"])

    hashes, path = cut(values.distinct().mapInArrow(run, "h long"))
    out = BitFilter(hashes)
    drop(values.sparkSession, path)
    return out


_WITH_MAIL, _WITHOUT = re.compile(f"{MAIL}|{REST}"), re.compile(REST)


def regions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of tokens, one white sign apart, that each have a digit or @: no candidate lies elsewhere."""
    start, end = tokens_of(data, offsets)
    if not len(start):
        return start, end
    has = np.logical_or.reduceat(_DIGITS[data] | (data == 64), start)
    start, end = start[has], end[has]
    if len(start) < 2:
        return start, end
    near = start[1:] == end[:-1] + 1
    text = np.searchsorted(offsets, start, "right")
    near &= text[1:] == text[:-1]
    return start[np.concatenate([[True], ~near])], end[np.concatenate([~near, [True]])]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``SCHEMA``.  Only tokens with a digit or @, and runs of them, are searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "t"):
            start, end = regions(data, offsets)
            raw, out = data.tobytes(), []
            doc = np.searchsorted(offsets, start, "right") - 1
            known, text, doc_id = -1, "", None
            for k, a, b in zip(doc.tolist(), start.tolist(), end.tolist()):
                part = raw[a:b].decode("utf-8", "replace")
                for m in (_WITH_MAIL if "@" in part else _WITHOUT).finditer(part):
                    if k != known:
                        known, text, doc_id, at = k, rows.column(1)[k].as_py(), rows.column(0)[k].as_py(), int(offsets[k])
                        plain = text.isascii()
                    shift = a - at if plain else len(raw[at:a].decode("utf-8", "replace"))
                    out.append((doc_id, *described(m, text, shift)))
            if out:
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string())))], ["doc_id", "kind", "start", "end", "value", "seed", "patterns"])

    return docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("t")).where("t is not null").mapInArrow(run, SCHEMA)


def occurrences(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, start, end, value) of units that may be among the written ``values``; whoever joins them drops the rest."""
    maybe = value_hashes(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "t"):
            start, _, h, leads = spans(data, offsets)
            at = np.concatenate([start[maybe.passes(h.view(np.int64))], np.array([a for a, _ in leads], np.int64)])
            out = []
            for k in np.unique(np.searchsorted(offsets, at, "right") - 1).tolist():
                text, doc_id = rows.column(1)[k].as_py(), rows.column(0)[k].as_py()
                own = list(units(text))
                raw = [x[2].encode() for x in own]
                ends = np.cumsum([0, *map(len, raw)])
                passed = maybe.passes(rough_hashes(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:]).view(np.int64)) if own else ()
                out += [(doc_id, *x) for x in uncovered(text, [x for x, p in zip(own, passed) if p])]
            if out:
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "start", "end", "value"])

    return docs.mapInArrow(run, "doc_id long, start int, end int, value string")


def total_counts(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(value, total): the occurrences of units, and of single tokens in longer ones, that may be among the written ``values``."""
    maybe = value_hashes(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(batches, "t"):
            start, end, h, leads = spans(data, offsets)
            keep = np.flatnonzero(maybe.passes(h.view(np.int64)))
            raw = data.tobytes()
            seen = Counter(raw[a:b].decode("utf-8", "replace") for a, b in zip(start[keep].tolist(), end[keep].tolist()))
            for a, b in leads:  # values behind a lead, one by one
                token = raw[a:b].decode("utf-8", "replace")
                found = inside(token, 0)
                if found and found[2] != token.strip(EDGE):
                    seen[found[2]] += 1
            if seen:
                yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["value", "n"])

    return docs.mapInArrow(run, "value string, n long").groupBy("value").agg(F.sum("n").alias("total"))


def proposals(docs: DataFrame, slots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """(kind, value, pattern, mark) of what stands in slots, (pattern) of those that are out, and written paths; None without slots.

    ``docs`` is (doc_id, t).  The written ``slots`` (pattern, room, most) are patterns with the number of strings new to them
    that leaves them confident, and that number with the strings that they have in ``edges``.  Patterns go out in
    slices of about ``SLICE``, a pass over the texts for each; all that a slot can match have the same word
    before it, by which they are sliced.
    """
    if slots.isEmpty():
        return None

    def filled(docs: DataFrame, slots: DataFrame) -> tuple[DataFrame, str]:
        slices = max(1, -(-slots.count() // SLICE))
        word = F.substring_index(F.substring_index(F.substring_index("pattern", "|[", -1), "\t", 1), " ", -1)
        parts = []
        for k in range(slices):
            most = {r.pattern: r.most for r in slots.where(F.pmod(F.crc32(word.cast("binary")), F.lit(slices)) == k).select("pattern", "most").toLocalIterator()}
            parts.append(docs.mapInArrow(_in_slots(most), "kind string, value string, patterns array<string>, n long"))
        return cut(reduce(DataFrame.unionAll, parts).groupBy("kind", "value", "patterns").agg(F.sum("n").alias("n")))

    def full(taken: DataFrame) -> DataFrame:
        new = taken.select("kind", "value", F.explode("patterns").alias("pattern")).distinct().join(edges, ["kind", "value", "pattern"], "left_anti")
        return new.groupBy("pattern").agg(F.count(F.lit(1)).alias("taken")).join(slots, "pattern").where("taken > room").select("pattern")

    some, some_at = filled(docs.where(F.monotonically_increasing_id() % FIRST == 0), slots)
    early, early_at = cut(full(some))
    rest, rest_at = cut(slots.join(early, "pattern", "left_anti"))
    taken, taken_at = filled(docs, rest)
    out, out_at = cut(full(taken).unionAll(early))
    kept, kept_at = cut(taken.withColumn("pattern", F.explode("patterns")).join(out, "pattern", "left_anti"))
    drop(docs.sparkSession, some_at, early_at, rest_at, taken_at)
    total, total_at = cut(total_counts(docs, kept.select("value")))
    inside_ = kept.select("kind", "value", "patterns", "n").distinct().groupBy("kind", "value").agg(F.sum("n").alias("n"))
    marks = inside_.join(total, "value").select("kind", "value", F.when(F.col("n") < SHARE * F.col("total"), 0.0).alias("mark"))
    return kept.select("kind", "value", "pattern").distinct().join(marks, ["kind", "value"]), out, [out_at, kept_at, total_at]


def _in_slots(most: dict[str, int]):
    """Rows (doc_id, t) to (kind, value, patterns, n) of a batch.  A pattern that took more than its ``most`` different strings is out and takes no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, taken = Slots(set(most)), {p: set() for p in most}
        for batch in batches:
            rows: Counter = Counter()
            for text in batch.column(1).to_pylist():
                for _, _, value, kind, found in slots.found(" ".join(text.split())):
                    live = tuple(p for p in found if p in slots.confident)
                    for p in live:
                        taken[p].add(value)
                        if len(taken[p]) > most[p]:
                            slots.forget(p)
                    if live:
                        rows[kind, value, live] += 1
            if rows:
                kind, value, patterns = zip(*rows)
                yield pa.record_batch([pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(patterns, pa.list_(pa.string())), pa.array(list(rows.values()), pa.int64())], ["kind", "value", "patterns", "n"])

    return run


def bootstrap(found: DataFrame, rounds: int = ROUNDS, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(instances (kind, value, mark, score, slot), patterns (pattern, confidence)) of a cut candidate table, and their paths.

    With ``docs`` (doc_id, t), slots of confident patterns propose instances between the rounds; ``slot`` marks those.
    A slot is searched once, as soon as its pattern is confident.
    """
    spark = found.sparkSession
    # An instance that an announcing word made a seed once is one everywhere.
    instances, instances_at = cut(found.groupBy("kind", "value").agg(F.max("seed").alias("mark")).withColumn("score", F.coalesce("mark", F.lit(0.0))).withColumn("slot", F.lit(False)))
    edges, edges_at = cut(found.select("kind", "value", F.explode("patterns").alias("pattern")).distinct())
    patterns, patterns_at = None, None
    asked, out, spare = None, None, []  # patterns whose slots were searched, those of them that are out, and where they are written
    for turn in range(rounds):
        scored = edges.join(instances, ["kind", "value"])
        strength = F.sum("score") / (F.count(F.lit(1)) + DAMP)
        able = scored.groupBy("pattern").agg(strength.alias("confidence"), F.sum((F.col("score") >= ACCEPT).cast("int")).alias("good")).where((F.col("confidence") >= CONFIDENT) & (F.col("good") >= SUPPORT))
        confident, confident_at = cut(able.join(out, "pattern", "left_anti") if out is not None else able)
        belief = edges.join(confident, "pattern").groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("belief"))
        updated = instances.join(belief, ["kind", "value"], "left").select("kind", "value", "mark", F.coalesce("mark", "belief", F.lit(0.0)).alias("score"), "slot")
        new, new_at = cut(updated)
        drop(spark, instances_at, *([patterns_at] if patterns_at else []))
        instances, instances_at, patterns, patterns_at = new, new_at, confident, confident_at
        if docs is None or turn == rounds - 1:
            continue
        slots = confident.where(F.col("pattern").rlike(r"^[a-z]+\|\[")).select("pattern")
        if asked is not None:  # the texts are the same: a slot takes nothing new
            slots = slots.join(asked, "pattern", "left_anti")
        count = F.count(F.lit(1))
        room = F.greatest(F.lit(0), F.floor(F.sum("score") / CONFIDENT - count - DAMP + 1e-9))
        slots, slots_at = cut(edges.join(slots, "pattern").join(instances, ["kind", "value"]).groupBy("pattern").agg(room.alias("room"), (room + count).alias("most")))
        spare.append(slots_at)
        proposed = proposals(docs, slots, edges)
        if proposed:
            rows, gone, paths = proposed
            rows, rows_at = cut(rows)
            asked = slots.select("pattern") if asked is None else asked.unionAll(slots.select("pattern"))
            out = gone if out is None else out.unionAll(gone)
            spare.append(paths.pop(0))
            fresh = rows.groupBy("kind", "value").agg(F.max("mark").alias("mark")).join(instances, ["kind", "value"], "left_anti")
            new, new_at = cut(instances.unionByName(fresh.select("kind", "value", "mark", F.lit(0.0).alias("score"), F.lit(True).alias("slot"))))
            wide, wide_at = cut(edges.unionByName(rows.select("kind", "value", "pattern")).distinct())
            drop(spark, instances_at, edges_at, rows_at, *paths)
            instances, instances_at, edges, edges_at = new, new_at, wide, wide_at
    drop(spark, edges_at, *spare)
    return instances, patterns, [instances_at, patterns_at]


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value, score, seed) of each identifier."""
    spark = docs.sparkSession
    found, found_at = cut(candidates(docs, id_col, text_col))
    texts = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("t")).where("t is not null")
    instances, _, paths = bootstrap(found, docs=texts)
    accepted, accepted_at = cut(instances.where(F.col("score") >= ACCEPT).select("kind", "value", "score", (F.col("mark") == 1).alias("is_seed"), "slot"))
    known = found.join(accepted.where("not slot"), ["kind", "value"])
    out = known.select("doc_id", "kind", "start", "end", "value", "score", F.coalesce("is_seed", F.lit(False)).alias("seed"))
    others = accepted.where("slot")
    if not others.isEmpty():
        more = occurrences(texts, others.select("value")).join(others, "value")
        out = out.unionByName(more.select("doc_id", "kind", "start", "end", "value", "score", F.lit(False).alias("seed")))
    out, _ = cut(out)
    drop(spark, found_at, accepted_at, *paths)
    return out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers(table(spark, sf_dir, "documents"))
