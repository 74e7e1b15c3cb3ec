"""Token ids as compressed binary blocks: an adaptive context-mixing range coder.

Texts are tokenised with the vocabulary file of a public tokenizer (a path parameter).  Ids are gathered
into blocks of at most ``BLOCK`` tokens that are coded independently, each from empty statistics and with
a CRC-32 of its ids.  Orders 0, 1 and 2 each predict the next id from the ids that followed the same
context earlier in the block; their predictions are mixed with weights that follow how often each order
held the coming id (apart by how much that context was seen), and the mixture drives a 64-bit range coder.
Statistics advance at the positions in ``EPOCHS``, so that an encoder can count them with sorts and
cumulative sums over many blocks at once, and code many blocks in lockstep.  All arithmetic is on integers.

Defined results: one row for each block (``doc_ids``, ``lengths``: the documents it holds, in order; a
document longer than a block has its parts in blocks ``part`` 0, 1, ... of its own).  A null or empty text
has no tokens and an entry of length 0; a null or repeated ``doc_id`` is kept as it is.  Vocabularies of up to
``MOST_IDS`` ids can be coded, larger ones are refused.  An empty table has no blocks; other columns are ignored.  ``decode`` gives the ids back and raises on a block whose checksum fails.
"""

from __future__ import annotations

import base64
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm import textkit as tk
from brindle.llm.common import q, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks are counted ``TOGETHER`` at a time, which fits the caches, and coded in ``LANES``; neither changes the result.
BLOCK, LANES, STEPS, TOGETHER, CACHE = 8192, 384, 64, 2, 400_000
EPOCHS = np.array([0, 64, 128, 256, 512, 768, 1024, 1536, 2048, 3072, 4096, 5120, 6144, 7168, BLOCK])
TOTAL_BITS, WEIGHT_BITS, BUCKETS = 24, 12, 8
MOST_IDS = 1 << 22
SCHEMA = "doc_ids array<long>, lengths array<int>, part int, n_tokens int, crc long, payload binary"


#: By the last five bits of a first byte, and the second byte: which characters of two bytes are letters.
_LETTER = np.zeros(1 << 13, bool)
_LETTER[[c >> 6 << 8 | 0x80 | c & 63 for c in range(0x80, 0x800) if unicodedata.category(chr(c))[0] == "L"]] = True


class Tokenizer:
    """Byte-level BPE from a rank file.  Equal pieces of a run of texts are merged once."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self._forget()
        self.encoding = tiktoken.Encoding("blocks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _forget(self) -> None:
        # Pieces by number, and their ids one after another: no object for each that the garbage collector would visit.
        self._known: dict[bytes, int] = {}
        self._ids, self._ends = array("I"), array("q", [0])

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents and the first id of each.

        Pieces that are one optional space and letters of one or two bytes are found and hashed over the whole run;
        what lies between them goes through the pattern.  A stretch is cut only where the pattern would cut too.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start, end, plain = self._stretches(data, offsets)
        # Equal stretches of up to 24 bytes are merged once: they stand together by hash, and are compared with the one before.
        padded = np.concatenate([data, np.zeros(32, np.uint8)])
        eight = np.ndarray((n + 24,), "<u8", padded, 0, (1,))
        size = end - start
        h = size.astype(np.uint64)
        for at in (16, 8, 0):
            some = np.flatnonzero(size > at) if at else slice(None)
            spare = np.uint64(64) - np.minimum(size[some] - at, 8).astype(np.uint64) * np.uint64(8)
            h[some] = tk.mix(h[some] ^ (eight[start[some] + at] << spare >> spare))
        order = np.argsort(h)
        h, size, begin = h.take(order), size.take(order), start.take(order)
        new = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        new[1:] |= size[1:] != size[:-1]
        new |= size > 24
        more = np.flatnonzero(~new & (size > 8))  # up to 8 bytes of one size have a hash of their own
        a, b, last = begin.take(more), begin.take(more - 1), size.take(more) - 8
        new[more] = (eight[a] != eight[b]) | (eight[a + last] != eight[b + last]) | (last > 8) & (eight[a + 8] != eight[b + 8])
        first, which = order[new], np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        raw = data.tobytes()
        encode, merge = self.encoding._core_bpe.encode_ordinary, self.encoding._core_bpe.encode_single_piece
        if len(self._ends) > CACHE or len(self._ids) > 8 * CACHE:
            self._forget()
        known, stored, ends, numbers = self._known, self._ids, self._ends, []
        for a, b, simple in zip(start[first].tolist(), end[first].tolist(), plain[first].tolist()):
            piece = raw[a:b]
            k = known.get(piece)
            if k is None:
                stored.extend(merge(piece) if simple else encode(piece.decode("utf-8", "replace")))
                k = len(ends) - 1
                ends.append(len(stored))
                if b - a < 64:
                    known[piece] = k
            numbers.append(k)
        flat, bounds, number = np.array(stored, np.uint32), np.array(ends, np.int64), np.array(numbers, np.int64)
        at, size = bounds[number], bounds[number + 1] - bounds[number]
        n_out = size[which]
        out_at = np.concatenate([[0], np.cumsum(n_out)])
        ids = flat[np.repeat(at[which] - out_at[:-1], n_out) + np.arange(out_at[-1])]
        doc_first = np.searchsorted(start, offsets)
        return ids, out_at[doc_first]

    @staticmethod
    def _stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans that cover the run, and which of them are single plain pieces.

        A plain piece is `` ?`` and letters below U+0800 between a byte that is ASCII and no letter (or the document's
        edge) and the same.  Not taken are pieces after an apostrophe, as contractions are the pattern's first choice, and
        after a line end or tab that follows white space, as the pattern splits such a run before its last one.
        """
        n = len(data)
        low = data | 32
        letter = (low >= 97) & (low <= 122) & (data < 128)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0) & ~edge[1:-1])
        lead = lead[_LETTER[(data[lead].astype(np.int64) & 31) << 8 | data[lead + 1]]]
        letter[lead] = letter[lead + 1] = True
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = letter
        begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        before = np.where(edge[begin], 0, data[np.maximum(begin - 1, 0)])
        after = np.where(edge[end], 0, data[np.minimum(end, n - 1)])
        earlier = np.where(edge[begin] | edge[np.maximum(begin - 1, 0)], 0, data[np.maximum(begin - 2, 0)])
        run = (before != 32) & (before != 0) & (before <= 32) & ((earlier <= 32) & (earlier > 0) | (earlier >= 128))
        ok = (before < 128) & (after < 128) & (before != 39) & ~run
        begin, end = begin[ok] - (before[ok] == 32), end[ok]
        is_begin = np.zeros(n + 1, bool)
        is_begin[begin] = True
        is_cut = is_begin.copy()
        is_cut[end] = is_cut[offsets] = True
        cuts = np.flatnonzero(is_cut)
        return cuts[:-1], cuts[1:], is_begin[cuts[:-1]]


@lru_cache(1)
def _tokenizer(path: str) -> Tokenizer:
    """One for all tasks of a worker, with the pieces that it knows."""
    return Tokenizer(path)


_BUCKET = np.minimum([k.bit_length() for k in range(BLOCK + 1)], BUCKETS - 1).astype(np.int64)


def _before(pair: np.ndarray, first: np.ndarray, last: np.ndarray, epoch: np.ndarray) -> tuple[np.ndarray, ...]:
    """The tokens whose key comes before their epoch, and for each of them, among the tokens with its key before its epoch: those with a smaller id, with its id, and all.

    ``pair`` numbers keys and ids in their order; ``first`` and ``last`` are, for each pair, the first pair of its key and the one after the last.
    """
    wide, epochs = len(first) + 1, int(epoch.max(initial=0)) + 1
    row = epoch.astype(np.int64) * wide
    at = row + pair
    # Tokens by epoch and pair, a row further on and a place to the right: summed down and along, what is before both.
    total = np.bincount(at + (wide + 1), minlength=epochs * wide)[: epochs * wide].reshape(epochs, wide)
    for e in range(1, epochs):
        total[e] += total[e - 1]
    total = np.cumsum(total.ravel())
    row += first.take(pair)
    base = total.take(row)
    seen = total.take(at - pair + last.take(pair)) - base
    has = np.flatnonzero(seen > 0)
    at = at.take(has)
    less = total.take(at)
    same = total.take(at + 1) - less
    return has, less - base.take(has), same, seen.take(has)


def _counts(keys: np.ndarray, ids: np.ndarray, epoch: np.ndarray, number: bool = False) -> tuple[tuple[np.ndarray, ...], np.ndarray | None]:
    """``_before`` of any keys and ids.

    With ``number``, a number for the key and id of every token as well.  Key, id and place are sorted as one integer each (ids and places have 17 bits).
    """
    n = len(ids)
    pairs = np.sort(keys << 34 | ids << 17 | np.arange(n))
    order = pairs & 0x1FFFF
    pairs >>= 17
    new = np.ones(n, bool)
    np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
    start = np.flatnonzero(new)
    pair = np.empty(n, np.int64)
    pair[order] = np.cumsum(new) - 1
    key = pairs.take(start) >> 17
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(first, append=len(key))
    return _before(pair, np.repeat(first, size), np.repeat(first + size, size), epoch), pair + 1 if number else None


def _weights(hits: np.ndarray, trials: np.ndarray) -> np.ndarray:
    return ((2 * hits + 1) << WEIGHT_BITS) // (2 * trials + 2)


def _part(share: np.ndarray, count: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """share * count // seen; the product is below 2**38 and ``seen`` at most ``BLOCK``, so the quotient of doubles has the right whole part."""
    return (share * count / seen).astype(np.int64)


def intervals(ids: np.ndarray, block: np.ndarray, position: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, width) of every token in a range of 2**TOTAL_BITS, given its block and place in it."""
    n, real = len(ids), ids
    if vocabulary >= 1 << 17:  # keys have 17 bits for an id: larger ones by their rank among these, which keeps their order
        ids = np.unique(ids, return_inverse=True)[1]
    epoch = (np.searchsorted(EPOCHS, np.arange(int(position.max(initial=0)) + 1), "right") - 1)[position]
    n_epochs = int(epoch.max(initial=0)) + 1
    blocks = int(block.max(initial=0)) + 1
    base = block.astype(np.int64)
    begins = np.flatnonzero(position == 0)
    alone = int(ids.max(initial=0)) + 1
    own = base * alone + ids
    there = np.zeros(blocks * alone, bool)
    there[own] = True
    number = np.flatnonzero(there)
    size = np.bincount(number // alone, minlength=blocks)
    rank = np.empty(blocks * alone, np.int64)
    rank[number] = np.arange(len(number))
    own = rank.take(own)
    by_none = _before(own, np.repeat(np.cumsum(size) - size, size), np.repeat(np.cumsum(size), size), epoch)
    # Nothing is before the contexts of a block's first two tokens, which have numbers that others don't.
    one = np.zeros(n, np.int64)
    one[1:] = own[:-1] + 1
    one[begins] = 0
    by_one, pair = _counts(one, ids, epoch, True)
    two = np.zeros(n, np.int64)  # the last two ids are what the token before had as context and id
    two[1:] = pair[:-1]
    two[begins] = 0
    often = np.flatnonzero(np.bincount(two).take(two) > 1)
    (at, *found), _ = _counts(two.take(often), ids.take(often), epoch.take(often))
    by_two = (often.take(at), *found)
    low = np.zeros(n, np.int64)
    width = np.zeros(n, np.int64)
    room = np.full(n, (1 << TOTAL_BITS) - vocabulary, np.int64)
    reached = np.ones(n, bool)
    for at, less, same, seen in (by_two, by_one, by_none):
        slot = (base.take(at) * BUCKETS + _BUCKET.take(seen)) * n_epochs + epoch.take(at)
        hit = np.flatnonzero(same > 0)
        tried = reached.take(at)
        trials, hits = (np.bincount(slot.take(x), minlength=blocks * BUCKETS * n_epochs).reshape(-1, n_epochs) for x in (np.flatnonzero(tried), hit.compress(tried.take(hit))))
        # A weight follows what was tried before the epoch.
        weight = _weights(np.cumsum(hits, axis=1) - hits, np.cumsum(trials, axis=1) - trials).ravel().take(slot)
        left = room.take(at)
        share = left * weight >> WEIGHT_BITS
        room[at] = left - share
        a = _part(share, less, seen)
        low[at] += a
        width[at] += _part(share, less + same, seen) - a
        reached[at.take(hit)] = False
    each = room // vocabulary + 1
    return low + each * real, width + each


def range_encode(low: np.ndarray, width: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Code blocks (runs between ``first``) in lockstep, ``STEPS`` places at a time so that turned arrays stay in the caches."""
    lengths = np.diff(first)
    lanes, steps = len(lengths), int(lengths.max(initial=0))
    given = np.zeros((2, lanes, steps + 16), np.uint32)  # no row is a power of two long: those would share cache lines
    given[1] = 1 << TOTAL_BITS
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        given[0, k, : b - a], given[1, k, : b - a] = low[a:b], width[a:b]
    words = np.zeros((lanes, steps + 18), np.uint32)
    out = np.zeros((lanes, steps + 2), bool)
    carry = np.zeros((lanes, steps), bool)
    base, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    unit, add, by = np.empty((3, lanes), np.uint64)
    bases, (outs, carries) = np.empty((STEPS, lanes), np.uint64), np.empty((2, STEPS, lanes), bool)
    shift24, shift32, shift5, one = np.uint64(TOTAL_BITS), np.uint64(32), np.uint64(5), np.uint64(1)
    for t in range(0, steps, STEPS):
        some = slice(t, min(t + STEPS, steps))
        n = some.stop - t
        at, size = (x[:, some].T.astype(np.uint64, order="C") for x in given)
        for x, y, reached, over, short in zip(at, size, bases, carries, outs):
            np.right_shift(span, shift24, unit)
            np.multiply(unit, x, add)
            np.add(base, add, reached)
            np.less(reached, add, over)
            np.multiply(unit, y, span)
            np.right_shift(span, shift32, by)  # by 32 bits if none of the upper 32 is left
            np.minimum(by, one, by)
            np.less(by, one, short)
            np.bitwise_xor(by, one, by)
            np.left_shift(by, shift5, by)
            np.left_shift(reached, by, base)
            np.left_shift(span, by, span)
        words[:, some], out[:, some], carry[:, some] = (bases[:n] >> shift32).T, outs[:n].T, carries[:n].T
    words[:, steps], words[:, steps + 1] = base >> shift32, base & np.uint64(0xFFFFFFFF)
    out[:, steps:] = True
    coded = []
    for k in range(lanes):
        sent = np.flatnonzero(out[k])
        w = words[k].take(sent)
        value = int.from_bytes(w.astype(">u4").tobytes(), "big")
        where = np.flatnonzero(carry[k])
        if len(where):  # a carry belongs to the last word written before it
            extra = np.bincount(np.searchsorted(sent, where) - 1, minlength=len(w)).astype(">u4")
            value += int.from_bytes(extra.tobytes(), "big")
        coded.append(value.to_bytes(4 * len(w), "big").rstrip(b"\0"))
    return coded


def decode_block(payload: bytes, n: int, vocabulary: int) -> np.ndarray:
    """The ids of a block, one after another, with the statistics that the encoder had at each epoch."""
    data = payload + bytes(16)
    code, read = int.from_bytes(data[:8], "big"), 8
    span, mask = (1 << 64) - 1, (1 << 64) - 1
    orders: list[dict] = [{}, {}, {}]
    hits, trials = np.zeros((3, BUCKETS), np.int64), np.zeros((3, BUCKETS), np.int64)
    weights = _weights(hits, trials).tolist()
    ids: list[int] = []
    waiting: list[tuple] = []
    ends = set(EPOCHS[1:].tolist())
    for t in range(n):
        one = ids[-1] + 1 if t else 0
        two = ids[-2] + 1 if t > 1 else 0
        contexts = (0, one, (one, two))
        room, parts = (1 << TOTAL_BITS) - vocabulary, []
        buckets = []
        for k in (2, 1, 0):
            seen = orders[k].get(contexts[k], ())
            bucket = min(len(seen).bit_length(), BUCKETS - 1)
            buckets.append((k, bucket, seen))
            if seen:
                share = room * weights[k][bucket] >> WEIGHT_BITS
                room -= share
                parts.append((share, seen, len(seen)))
        each = room // vocabulary + 1

        def below(x: int, parts: list = parts, each: int = each) -> int:
            return sum(s * bisect_left(seen, x) // m for s, seen, m in parts) + each * x

        unit = span >> TOTAL_BITS
        target = code // unit
        a, b = 0, vocabulary
        while b - a > 1:
            m = (a + b) // 2
            if below(m) <= target:
                a = m
            else:
                b = m
        lo, hi = below(a), below(a + 1)
        code -= unit * lo
        span = unit * (hi - lo)
        if span < 1 << 32:
            code = (code << 32 | int.from_bytes((data[read : read + 4] + b"\0\0\0\0")[:4], "big")) & mask
            read += 4
            span <<= 32
        waiting.append((contexts, a, [(k, b) for k, b, _ in buckets]))
        open_ = True
        for k, bucket, seen in buckets:
            if open_:
                trials[k, bucket] += 1
                at = bisect_left(seen, a)
                if at < len(seen) and seen[at] == a:
                    hits[k, bucket] += 1
                    open_ = False
        ids.append(a)
        if t + 1 in ends:
            weights = _weights(hits, trials).tolist()
            for ctx, x, _ in waiting:
                for k in range(3):
                    insort(orders[k].setdefault(ctx[k], []), x)
            waiting = []
    return np.array(ids, np.uint32)


def encode_blocks(ids: np.ndarray, first: np.ndarray, vocabulary: int) -> list[tuple[int, bytes]]:
    """(crc, payload) of each run of ids between ``first``."""
    if vocabulary > MOST_IDS or len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"ids are below {vocabulary}, and a vocabulary has {MOST_IDS} at most")
    lengths = np.diff(first)
    low, width = np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
    together = TOGETHER if vocabulary < 1 << 17 else TOGETHER // 2
    for k in range(0, len(lengths), together):
        n, at = lengths[k : k + together], first[k : k + together + 1]
        block = np.repeat(np.arange(len(n)), n)
        position = np.arange(n.sum()) - np.repeat(at[:-1] - at[0], n)
        low[at[0] : at[-1]], width[at[0] : at[-1]] = intervals(ids[at[0] : at[-1]].astype(np.int64), block, position, vocabulary)
    coded = range_encode(low, width, first)
    wide = ids.astype("<u4")
    return [(zlib.crc32(wide[a:b].tobytes()), c) for a, b, c in zip(first[:-1].tolist(), first[1:].tolist(), coded)]


def _layout(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Block bounds over the ids of documents with these counts, and (first document, last one + 1, part) of each block."""
    bounds, holds = [0], []
    start, at, total = 0, 0, np.concatenate([[0], np.cumsum(counts)])
    for d, n in enumerate(counts.tolist()):
        if n > BLOCK or total[d + 1] - at > BLOCK:
            if d > start:
                holds.append((start, d, 0))
                bounds.append(int(total[d]))
            start, at = d, int(total[d])
        if n > BLOCK:
            for part, to in enumerate(range(BLOCK, n + BLOCK, BLOCK)):
                holds.append((d, d + 1, part))
                bounds.append(int(total[d]) + min(to, n))
            start, at = d + 1, int(total[d + 1])
    if len(counts) > start:
        holds.append((start, len(counts), 0))
        bounds.append(int(total[-1]))
    return np.array(bounds, np.int64), holds


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Blocks of the documents' token ids; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary_path)
        for rows, data, offsets in tk.chunks(batches, "t", 4 << 20):
            ids, first = tokenizer.encode_all(data, offsets)
            counts = np.diff(first)
            bounds, holds = _layout(counts)
            names = rows.column(0).to_pylist()
            for a in range(0, len(holds), LANES):
                part = holds[a : a + LANES]
                cut = bounds[a : a + len(part) + 1]
                coded = encode_blocks(ids[cut[0] : cut[-1]], cut - cut[0], tokenizer.size)
                n = np.diff(cut).tolist()
                lengths = [[n[k]] if counts[s] > BLOCK else counts[s:e].tolist() for k, (s, e, _) in enumerate(part)]
                yield pa.record_batch(
                    [
                        pa.array([names[s:e] for s, e, _ in part], pa.list_(pa.int64())),
                        pa.array(lengths, pa.list_(pa.int32())),
                        pa.array([x[2] for x in part], pa.int32()),
                        pa.array(n, pa.int32()),
                        pa.array([c for c, _ in coded], pa.int64()),
                        pa.array([p for _, p in coded], pa.binary()),
                    ],
                    ["doc_ids", "lengths", "part", "n_tokens", "crc", "payload"],
                )

    return docs.select(q(id_col).cast("long").alias("id"), q(text_col).alias("t")).mapInArrow(run, SCHEMA)


def decode(blocks: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, ids) of each document, or part of one, in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _tokenizer(vocabulary_path).size
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["payload"], row["n_tokens"], size)
                if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc"]:
                    raise ValueError(f"a block's checksum fails (documents {row['doc_ids'][:3]})")
                ends = np.cumsum([0, *row["lengths"]])
                parts = [ids[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(parts), pa.int32()), pa.array([x.tolist() for x in parts], pa.list_(pa.int64()))], ["doc_id", "part", "ids"])

    return blocks.mapInArrow(run, "doc_id long, part int, ids array<long>")


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
