"""Vectorised text primitives over Arrow string columns.

Whole batches are turned into word spans, word hashes and shingle hashes with NumPy passes over the
UTF-8 bytes, so no Python string is made per word.  A word is a maximal run of ASCII letters or digits
and non-ASCII characters; case is folded for ASCII and Latin-1 letters.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 2 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            out = np.ones(1, U64)
            while len(out) < size:
                out = np.concatenate([out, out * U64(pow(base, len(out), 1 << 64))])
            _POWERS[key] = out
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Words:
    """Words of a run of documents: byte spans, hashes, and the first word of each document."""

    __slots__ = ("data", "doc_start", "end", "first", "hash", "offsets", "start", "n_docs")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        n = len(data)
        is_word = _WORD[data]
        edge = np.empty(n + 1, bool)
        edge[0], edge[1:] = True, False
        edge[offsets] = True
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = is_word
        begin = inside[1:] & (~inside[:-1] | edge)  # position i: a word starts here
        begin[n] = False
        finish = inside[:-1] & (~inside[1:] | edge)  # position i: a word ended just before
        self.start = np.flatnonzero(begin).astype(np.int64)
        self.end = np.flatnonzero(finish).astype(np.int64)
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        low = _LOWER[data] if fold else data
        if fold and n and (data == 0xC3).any():
            up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
            low[up] += 0x20
        p, q = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((low.astype(U64) + U64(1)) * p[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * q[self.start])

    def counts(self) -> np.ndarray:
        """Words in each document."""
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = _CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches to about ``size`` bytes of text; a longer document comes whole, alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        del batch, data  # not beside the next one


def frugal(run: Callable) -> Callable:
    """``run`` over record batches, after which the worker gives freed memory back to the system.

    A task with two Python steps takes two workers, and the idle ones stay beside those of the next stage.
    """

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return to_the_end


def release() -> None:
    """Give freed memory back to the system: Arrow's, and with glibc that of NumPy."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and the first shingle of each document.

    A document of 1 to k-1 words has one shingle, of all its words; one without words has none.
    """
    h, n = words.hash, len(words.hash)
    counts = words.counts()
    whole = np.zeros(n, U64)
    for t in range(k):
        part = np.zeros(n, U64)
        part[: max(0, n - t)] = h[t:] * U64((2 * t + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        whole += part
    starts, have = words.first[:-1], np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    first = np.concatenate([[0], np.cumsum(have)])
    index = np.repeat(starts - first[:-1], have) + np.arange(first[-1])
    out = whole[index]
    short = np.flatnonzero((counts > 0) & (counts < k))
    for d in short:
        acc = 0
        for t in range(counts[d]):
            acc = (acc + int(h[starts[d] + t]) * ((2 * t + 1) * 0xD6E8FEB86659FD93)) & (1 << 64) - 1
        out[first[d]] = acc
    return mix(out), first


def binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Variable-length rows of a flat array, as binary."""
    values = np.ascontiguousarray(values)
    at = (first * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Variable-length rows of a flat array, as lists."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))
