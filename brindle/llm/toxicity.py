"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are lexicon densities (a seed lexicon, words and word beginnings learned from the labels),
second-person proximity, capitals, punctuation, symbol and obfuscation rates and repetition.  The lexicon
comes from all labelled documents: a unit in at least ``LEAST`` toxic ones enters if its log odds of toxic
against clean documents are high and significant, so the lexicon grows with the labels.  The trees are
fitted to about ``SAMPLE`` labelled rows at most, half of either kind if there are so many, weighted back to
their share among all labels; their features come from a lexicon of the other half of the documents, so that
no row is judged by words that it brought in.  Scores are calibrated on the third of the sample that the
trees did not see.

Defined results: one row for each row of the table.  Null and empty texts are not toxic (probability 0).
Texts of any length are judged whole; equal texts get equal probabilities, also where scores tie (one step
of the calibration).  With fewer than three labelled documents of either kind nothing is toxic.  Labels whose
values are null are left out; a document that several labels name counts once for each.  Other columns are
ignored, or kept by the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import textkit as tk
from brindle.llm.boosting import Boosted, Isotonic
from brindle.llm.common import BitFilter, having, q, table
from brindle.storage import cut, drop

SAMPLE, REJECT, PREFIX, NEAR, LEAST = 20_000, 0.5, 5, 6, 3
SEED_WORDS = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown jerk creep filth garbage imbecile freak".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer tú ti tus usted ustedes vosotros".split()


def word_hashes(words: list[str]) -> np.ndarray:
    data, offsets = tk.buffers(pa.array([" ".join(words)], pa.string()))
    return np.unique(tk.Words(data, offsets).hash)


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def beginnings(words: tk.Words) -> np.ndarray:
    """Hashes of the first PREFIX bytes of each longer word, apart from those of words; 0 for others."""
    long = np.flatnonzero(words.end - words.start > PREFIX)
    acc = np.zeros(len(long), np.uint64)
    for t in range(PREFIX):
        byte = words.data[words.start[long] + t]
        acc = acc * tk.U64(0x100000001B3) + tk._LOWER[byte].astype(np.uint64) + tk.U64(1)
    out = np.zeros(len(words.hash), np.uint64)
    out[long] = tk.mix(acc ^ tk.U64(0x5BD1E995)) | tk.U64(1)
    return out


class Lexicon:
    """Sorted hashes of strong words, weak words and word beginnings."""

    def __init__(self, strong: np.ndarray, weak: np.ndarray):
        self.strong, self.weak = np.sort(strong), np.sort(weak)
        self.seed, self.second = word_hashes(SEED_WORDS), word_hashes(SECOND_PERSON)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = tk.Words(data, offsets)
        n_docs, counts = words.n_docs, words.counts()
        doc = words.doc()
        begin = beginnings(words)
        per = np.maximum(counts, 1)
        total = lambda mask: np.bincount(doc[mask], minlength=n_docs)
        seed, strong, weak = is_in(words.hash, self.seed), is_in(words.hash, self.strong), is_in(words.hash, self.weak)
        start_strong, start_weak = is_in(begin, self.strong) & (begin > 0), is_in(begin, self.weak) & (begin > 0)
        hit = seed | strong
        at = np.flatnonzero(hit | start_strong)
        person = np.concatenate([[0], np.cumsum(is_in(words.hash, self.second))])
        low = np.maximum(at - NEAR, words.first[doc[at]])
        high = np.minimum(at + NEAR + 1, words.first[doc[at] + 1])
        near = np.bincount(doc[at[person[high] > person[low]]], minlength=n_docs)
        run = np.concatenate([[0], np.cumsum(hit | start_strong)])
        edge = np.minimum(np.arange(len(words.hash)) + 20, words.first[doc + 1]) if len(words.hash) else np.zeros(0, np.int64)
        dense = np.zeros(n_docs)
        if len(words.hash):
            full = np.flatnonzero(counts)
            dense[full] = np.maximum.reduceat(run[edge] - run[:-1], words.first[:-1][full])
        sizes = np.maximum(np.diff(offsets), 1)
        at_byte = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        upper = at_byte((data >= 65) & (data <= 90))
        letters = at_byte(((data | 32) >= 97) & ((data | 32) <= 122))
        marks = at_byte((data == 33) | (data == 63))
        symbols = at_byte(np.isin(data, np.frombuffer(b"*#$%&@|~^", np.uint8)))
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        alpha = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
        mixed = (digit[words.end] > digit[words.start]) & (alpha[words.end] > alpha[words.start])
        star = np.isin(data, np.frombuffer(b"*@$#", np.uint8))
        joined = np.zeros(len(words.hash), bool)  # a symbol between two letters: a masked word
        if len(words.hash) > 1:
            joined[:-1] = (words.start[1:] - words.end[:-1] == 1) & star[words.end[:-1]] & (doc[1:] == doc[:-1])
        repeated = np.zeros(n_docs)
        if len(words.hash) > 1:
            repeated = total(np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])]))
        n_hit = total(hit)
        return np.stack(
            [
                n_hit / per, total(weak) / per, total(start_strong) / per, total(start_weak) / per, total(seed) / per,
                np.log1p(n_hit), np.log1p(total(start_strong)), dense, near / np.maximum(n_hit, 1), upper / np.maximum(letters, 1),
                marks / sizes, symbols / sizes, (total(mixed) + total(joined)) / per, repeated / per, letters / per, np.log1p(counts),
            ],
            axis=1,
        ).astype(np.float64)


def _distinct_units(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, unit) pairs; units are words and word beginnings."""
    doc, begin = words.doc(), beginnings(words)
    have = begin > 0
    d = np.concatenate([doc, doc[have]])
    u = np.concatenate([words.hash, begin[have]])
    order = np.lexsort((u, d))
    d, u = d[order], u[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (u[1:] != u[:-1])
    return d[new], u[new]


def _count(only: BitFilter | None) -> Callable:
    """Partial document counts of units by fold: (u, n0, n1), over rows (t, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, "t"):
            d, u = _distinct_units(tk.Words(data, offsets))
            if only is not None:
                keep = only.passes(u)
                d, u = d[keep], u[keep]
            unit, at = np.unique(u, return_inverse=True)
            fold = rows.column(rows.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)[d]
            n = [np.bincount(at, fold == f, len(unit)).astype(np.int64) for f in (0, 1)]
            yield pa.record_batch([pa.array(unit.view(np.int64)), *map(pa.array, n)], ["u", "n0", "n1"])

    return run


def _learn(labelled: DataFrame) -> tuple[list[Lexicon], np.ndarray]:
    """Lexicons from fold 0, from fold 1 and from all rows of the cut table (id, t, y, fold); the number of clean and toxic rows."""
    spark = labelled.sparkSession
    sizes = np.zeros((2, 2))
    for y, fold, n in labelled.groupBy("y", "fold").count().collect():
        sizes[y, fold] = n
    counted = lambda y, only: labelled.where(F.col("y") == y).select("t", "fold").mapInArrow(tk.frugal(_count(only)), "u long, n0 long, n1 long").groupBy("u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    toxic, toxic_at = cut(counted(1, None).where(F.col("n0") + F.col("n1") >= LEAST))
    # Clean documents bring only units that may be among the toxic ones; what the filter lets pass besides has no partner in the join.
    clean = counted(0, BitFilter(toxic.select("u"))).select("u", F.col("n0").alias("c0"), F.col("n1").alias("c1"))
    both = toxic.join(clean, "u", "left").fillna(0, ["c0", "c1"])
    tests = []
    for k, folds in enumerate(([0], [1], [0, 1])):
        nt, nc = sum(F.col(f"n{f}") for f in folds), sum(F.col(f"c{f}") for f in folds)
        n1, n0 = float(sizes[1, folds].sum()), float(sizes[0, folds].sum())
        odds = F.log((nt + 0.5) / (n1 - nt + 0.5)) - F.log((nc + 0.5) / (n0 - nc + 0.5))
        z = odds / F.sqrt(1 / (nt + 0.5) + 1 / (nc + 0.5))
        tests += [((odds > 2.5) & (z > 4)).alias(f"strong{k}"), ((odds > 1.5) & (z > 2.3)).alias(f"weak{k}")]
    passed = both.select("u", *tests).where(" or ".join(f"strong{k} or weak{k}" for k in range(3))).toArrow().to_pandas()
    units = passed["u"].to_numpy(np.int64).view(np.uint64)
    out = [Lexicon(units[passed[f"strong{k}"].to_numpy(bool)], units[passed[f"weak{k}"].to_numpy(bool)]) for k in range(3)]
    drop(spark, toxic_at)
    return out, sizes.sum(axis=1)


class Model:
    """Lexicon, trees and calibration; ``None`` trees judge everything clean."""

    def __init__(self, lexicon: Lexicon, trees: Boosted | None, scale: Isotonic | None):
        self.lexicon, self.trees, self.scale = lexicon, trees, scale

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(offsets) - 1)
        p = self.scale.apply(self.trees.score(self.lexicon.features(data, offsets)))
        p[np.diff(offsets) == 0] = 0
        return p


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 11) -> Model:
    """Fit on documents joined with labels (doc_id, toxic)."""
    spark = docs.sparkSession
    known, known_at = cut(labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)"))
    texts = docs.select(q(id_col).alias("id"), q(text_col).alias("t")).where("t is not null")
    labelled, at = cut(having(texts, F.col("id"), known.select("id")).join(known, "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)).cast("int")))
    lexicons, sizes = _learn(labelled)
    # Half of the sample for either kind, and what one of them leaves over for the other.
    most = [max(sample // 2, sample - int(sizes[1 - y])) for y in (0, 1)]
    share = [min(1.0, most[y] / max(1.0, sizes[y])) for y in (0, 1)]
    drawn = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30))
    picked = labelled.where(drawn < F.when(F.col("y") == 1, int((1 << 30) * share[1])).otherwise(int((1 << 30) * share[0])))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, "t"):
            fold = rows.column(2).to_numpy(zero_copy_only=False)
            both = [lex.features(data, offsets) for lex in lexicons[:2]]
            x = np.where(fold[:, None] == 0, both[1], both[0])
            yield pa.record_batch([pa.array(x.tolist(), pa.list_(pa.float64())), rows.column(1), rows.column(3)], ["x", "y", "id"])

    found = picked.select("t", "y", "fold", "id").mapInArrow(tk.frugal(features), "x array<double>, y int, id long").toPandas()
    found = found.sort_values(["id", "y"], kind="stable", ignore_index=True)  # the fit does not depend on the order of partitions
    drop(spark, known_at, at)
    y = found["y"].to_numpy(float)
    if min((y == 0).sum(), (y == 1).sum()) < 3:
        return Model(lexicons[2], None, None)
    x = np.stack(found["x"].to_numpy())
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])  # probabilities keep the share of toxic rows among all labelled ones
    rank = np.empty(len(y), np.int64)  # every third row of either kind calibrates
    for k in (0, 1):
        rank[y == k] = np.arange(int((y == k).sum()))
    hold = rank % 3 == 0
    trees = Boosted().fit(x[~hold], y[~hold], weight[~hold])
    held = trees.score(x[hold])
    return Model(lexicons[2], trees, Isotonic().fit(held, y[hold], weight[hold]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, probability, toxic) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, "t"):
            p = model.probability(data, offsets)
            yield pa.record_batch([rows.column(0), pa.array(p), pa.array(p >= REJECT)], ["doc_id", "probability", "toxic"])

    named = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("t"))
    return named.mapInArrow(run, "doc_id long, probability double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows judged toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, text_col):
            keep = model.probability(data, offsets) < REJECT
            yield rows if keep.all() else rows.filter(pa.array(keep))

    return docs.mapInArrow(tk.frugal(run), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
