"""Benchmark decontamination: item-sized windows, SimHash within a Hamming radius, exact verification.

For each benchmark item of n words every n-word window of every document is a candidate (a shorter
document is one window).  Features are word bigrams weighted by their letters.  A window whose weight in
bigrams of the benchmark is below ``threshold`` times the lightest item of that size cannot reach the
threshold, so it needs no fingerprint; of all others a 64-bit SimHash is taken.  Fingerprints are cut into
``BLOCKS`` blocks: two within the radius differ in one block by ``radius // BLOCKS`` bits at most, so near
blocks find every item within the radius (multi-index hashing; Norouzi et al., 2012).  Those are verified by
weighted Jaccard similarity of the bigram sets.  ``RADIUS`` follows from ``THRESHOLD``: sets at similarity J
have cosine 2J / (1 + J) or so, at 0.6 they differ in 14.7 of 64 bits with a deviation of 3.4, and the radius
is 2.4 deviations more.  Within 11 bits of a block lie 130 million of its 2**32 values, so block values are
compared with each other and not looked up one by one.

Documents are never shuffled.  Items travel to the tasks in slices of ``SLICE`` at most; a larger
benchmark costs one pass a slice.

Defined results: one row for each document row and item that match, with the best window (the first of
equals).  Null and empty texts match nothing.  Items of fewer than ``SHORT`` words say nothing inside other
text, so only documents that consist of them match.  Items that share an ``item_id`` are items each, of which
the best one counts; texts of any length are read whole.  Rows without a ``doc_id`` have no result row, but
the filter judges them too.  Empty tables match nothing; other columns are ignored, or kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import textkit as tk
from brindle.llm.common import q, table

THRESHOLD, RADIUS, BLOCKS, SHORT, SLICE = 0.6, 23, 2, 5, 20_000
#: Features fingerprinted at once (64 floats each) and bytes of text that the filter judges at once: they bound memory and change no result.
AT_ONCE, RUN = 50_000, 1 << 19


def _features(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram hashes, their weights and the first of each document."""
    s, first = tk.shingles(words, 2)
    size = words.end - words.start
    index = np.repeat(words.first[:-1] - first[:-1], np.diff(first)) + np.arange(len(s))
    after = np.minimum(index + 1, np.repeat(words.first[1:] - 1, np.diff(first)))
    return s, np.where(after > index, size[index] + size[after], size[index]).astype(np.int64), first


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of rows of features; weight 0 pads."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=-1)
    signs = bits.astype(np.float32)
    signs *= 2
    signs -= 1
    total = np.einsum("wmb,wm->wb", signs, weights.astype(np.float32))
    return np.ascontiguousarray(np.packbits(total > 0, axis=-1)).view(np.uint64).reshape(-1)


def within_radius(windows: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (window, item) pairs at most ``radius`` bits apart, through blocks of which one is near."""
    found_w, found_i = [], []
    blocks = items.view(np.uint32).reshape(-1, BLOCKS)
    for at in range(0, len(windows), step := max(1, (1 << 20) // max(1, len(items)))):
        part = windows[at : at + step].view(np.uint32).reshape(-1, BLOCKS)
        apart = [np.bitwise_count(part[:, k, None] ^ blocks[None, :, k]) for k in range(BLOCKS)]
        near = apart[0] <= radius // BLOCKS
        for x in apart[1:]:
            near |= x <= radius // BLOCKS
        w, i = np.nonzero(near)
        close = sum(x[w, i].astype(np.int64) for x in apart) <= radius
        found_w.append(w[close] + at)
        found_i.append(i[close])
    return np.concatenate(found_w or [np.zeros(0, np.int64)]), np.concatenate(found_i or [np.zeros(0, np.int64)])


class Items:
    """A slice of the benchmark, ready to be matched against documents."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        data, offsets = tk.buffers(pa.array(texts, pa.string()))
        words = tk.Words(data, offsets)
        s, w, first = _features(words)
        self.sets: list[dict[int, int]] = []
        self.total: list[int] = []
        by_size: dict[int, list[int]] = {}
        self.ids, n_words, known = [], words.counts(), []
        for d in np.flatnonzero(n_words):
            a, b = first[d], first[d + 1]
            by_size.setdefault(int(n_words[d]), []).append(len(self.ids))
            self.ids.append(ids[d])
            self.sets.append(dict(zip(s[a:b].tolist(), w[a:b].tolist())))
            self.total.append(sum(self.sets[-1].values()))
            known.append((s[a:b], w[a:b]))
        self.known = np.unique(np.concatenate([x for x, _ in known])) if known else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.known >> tk.U64(42)).astype(np.int64)] = True
        self.sizes = []  # (words, items of that size, their fingerprints, least matching weight)
        for n, own in sorted(by_size.items()):
            prints = np.concatenate([simhash(known[i][0][None], known[i][1][None]) for i in own])
            self.sizes.append((n, np.array(own), prints, threshold * min(self.total[i] for i in own)))

    def _matched(self, s: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(self.bitmap[(s >> tk.U64(42)).astype(np.int64)])
        at = np.searchsorted(self.known, s[hit])
        return hit[self.known[np.minimum(at, len(self.known) - 1)] == s[hit]]

    def matches(self, words: tk.Words) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(document, item) -> (similarity, first word, words) of the best window."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        if not len(self.known) or not len(words.hash):
            return best
        s, w, first = _features(words)
        hit = self._matched(s)
        total = np.zeros(len(s) + 1, np.int64)
        total[hit + 1] = w[hit]
        total = np.cumsum(total)
        longest, least = max(1, self.sizes[-1][0] - 1), min(x[3] for x in self.sizes)
        reach = np.minimum(np.arange(len(s)) + longest, len(s))
        spots = np.flatnonzero(total[reach] - total[:-1] >= least)
        if not len(spots):
            return best
        doc = np.searchsorted(first, spots, "right") - 1
        end, begin = first[doc + 1], first[doc]
        for n, own, prints, need in self.sizes:
            m = max(1, n - 1)
            to = np.minimum(spots + m, end)
            ok = ((to - spots == m) | (spots == begin)) & (total[to] - total[spots] >= need)
            if n < SHORT:
                ok &= (spots == begin) & (to == end)
            for part in np.array_split(np.flatnonzero(ok), 1 + int(ok.sum()) * m // AT_ONCE):
                if not len(part):
                    continue
                index = spots[part][:, None] + np.arange(m)
                inside = index < to[part][:, None]
                index = np.minimum(index, len(s) - 1)
                fp = simhash(s[index], np.where(inside, w[index], 0))
                for x, i in zip(*within_radius(fp, prints, self.radius)):
                    p, item = part[x], int(own[i])
                    a, b = int(spots[p]), int(to[p])
                    here = dict(zip(s[a:b].tolist(), w[a:b].tolist()))
                    there = self.sets[item]
                    common = sum(weight for h, weight in here.items() if h in there)
                    j = common / (sum(here.values()) + self.total[item] - common)
                    key = (int(doc[p]), item)
                    start = a - int(begin[p])
                    if j >= self.threshold and (key not in best or (-j, start) < (-best[key][0], best[key][1])):
                        best[key] = (j, start, n)
        return best


def _slices(benchmark: DataFrame, id_col: str, text_col: str, threshold: float, radius: int) -> Iterator[Items]:
    ids, texts = [], []
    for row in benchmark.select(q(id_col).alias("i"), q(text_col).alias("t")).where("i is not null and t is not null").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        if len(ids) == SLICE:
            yield Items(ids, texts, threshold, radius)
            ids, texts = [], []
    if ids:
        yield Items(ids, texts, threshold, radius)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words) of each document and item that match."""
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    named = docs.select(q(id_col).alias("id"), q(text_col).alias("t")).where("id is not null and t is not null")
    out = None
    for items in _slices(benchmark, item_id, item_text, threshold, radius):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in tk.chunks(batches, "t"):
                best = items.matches(tk.Words(data, offsets))
                if best:
                    ids = rows.column(0).to_pylist()
                    found = [(ids[d], items.ids[i], j, at, n) for (d, i), (j, at, n) in best.items()]
                    yield pa.record_batch([pa.array(x) for x in zip(*found)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        part = named.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    out = docs
    for items in _slices(benchmark, item_id, item_text, threshold, radius):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in tk.chunks(batches, text_col, RUN):
                keep = np.ones(rows.num_rows, bool)
                keep[[d for d, _ in items.matches(tk.Words(data, offsets))]] = False
                yield rows if keep.all() else rows.filter(pa.array(keep))

        out = out.mapInArrow(tk.frugal(run), out.schema)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
