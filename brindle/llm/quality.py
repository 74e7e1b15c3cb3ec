"""Quality by positive-unlabelled learning with the non-negative risk estimator (Kiryo et al., 2017).

Trusted positives are documents whose label says so; the unlabelled rows are drawn from all rows, whatever
their label, as the estimator assumes.  The class prior comes first: a logistic model tells positives from
unlabelled rows of one half of the ids, and over all rows of the other half, counted by a grouped
aggregation, the least ratio of unlabelled to positive rows above a score, with its standard error, bounds
the share of positives (Blanchard et al., 2010).  Then an additive model over binned features of the text's
shape minimises ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with the sigmoid
loss; where the second term falls below zero its gradient is followed upwards, as in the paper.

Both fits see at most about ``SAMPLE`` positives and ``SAMPLE`` unlabelled rows, drawn by a hash of
``doc_id``; the prior is counted over all rows of its half, and every row is scored over its whole text.

Defined results: one row for each row of the table.  Null texts and texts without words are not good
(score null).  Without positives, or texts, every text with words is good (score null).  Texts of any
length are scored whole; equal texts get equal scores, and a score of one half is not good.  A repeated
``doc_id`` is a row each time; a label with nulls is no label.  Other columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import textkit as tk
from brindle.llm.common import q, table
from brindle.storage import cut, drop

SAMPLE, BINS, STEPS, BATCH, RATE, DECAY = 20_000, 16, 1200, 1024, 0.02, 1e-4
_CLASSES = [b"|", b"%#$&*", b"!?", b".,;:", b"0123456789", b"\n", b" ", b"<>{}[]=/\\", b"()\"'"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rates of marks, capitals and repetition, word shapes and length, of each document."""
    words = tk.Words(data, offsets)
    n_docs, counts, doc = words.n_docs, words.counts(), words.doc()
    per, size = np.maximum(counts, 1), np.maximum(np.diff(offsets), 1)
    kind = np.zeros(256, np.uint8)
    for k, marks in enumerate(_CLASSES):
        kind[np.frombuffer(marks, np.uint8)] = k + 1
    kind[65:91], kind[97:123] = 20, 21
    kinds = kind[data]
    byte_doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(offsets))
    table_ = np.bincount(byte_doc * 32 + kinds, minlength=n_docs * 32).reshape(n_docs, 32)
    columns = [table_[:, k + 1] / size for k in range(len(_CLASSES))]
    upper, lower = table_[:, 20], table_[:, 21]
    columns += [upper / np.maximum(upper + lower, 1), (upper + lower) / size]
    length = (words.end - words.start).astype(np.float64)
    mean = np.bincount(doc, length, n_docs) / per
    columns += [mean, np.sqrt(np.maximum(np.bincount(doc, length**2, n_docs) / per - mean**2, 0)), np.bincount(doc[length <= 3], minlength=n_docs) / per, np.bincount(doc[length > 20], minlength=n_docs) / per]

    def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        mixed = tk.mix(values ^ tk.mix(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(mixed)
        new = np.ones(len(order), bool)
        new[1:] = mixed[order[1:]] != mixed[order[:-1]]
        return np.bincount(owner[order[new]], minlength=n_docs)

    columns.append(distinct(words.hash, doc) / per)
    grams, first = tk.shingles(words, 4)
    n_grams = np.diff(first)
    columns.append(1 - distinct(grams, np.repeat(np.arange(n_docs), n_grams)) / np.maximum(n_grams, 1))
    same = np.zeros(len(doc), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    columns.append(np.bincount(doc[same], minlength=n_docs) / per)
    columns.append(np.log1p(counts))
    return np.stack(columns, axis=1)


class Binned:
    """One-hot bins of features, at quantiles of a reference sample."""

    def __init__(self, reference: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in reference.T]
        # rare values matter most: the extreme percentiles get bins of their own
        self.edges = [np.unique(np.concatenate([e, np.quantile(c, [0.01, 0.99])])) for e, c in zip(self.edges, reference.T)]
        self.first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The active coordinates of each row, one a feature."""
        return np.stack([np.searchsorted(e, c, "left") + f for e, c, f in zip(self.edges, x.T, self.first)], axis=1)


class Adam:
    def __init__(self, n: int):
        self.w, self.m, self.v, self.t = np.zeros(n), np.zeros(n), np.zeros(n), 0

    def step(self, gradient: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient**2 - self.v)
        self.w -= rate * self.m / (1 - 0.9**self.t) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _gradient(at: np.ndarray, slope: np.ndarray, n: int) -> np.ndarray:
    """Of a mean over rows with active coordinates ``at`` and derivatives ``slope``; the last one is the bias."""
    out = np.bincount(at.reshape(-1), np.repeat(slope, at.shape[1]), n)
    out[-1] = slope.sum()
    return out / len(slope)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Separator:
    """A logistic score that tells positives from unlabelled rows, and cuts of it for counting."""

    def __init__(self, bins: Binned, p: np.ndarray, u: np.ndarray, rng: np.random.Generator):
        n = int(bins.first[-1]) + 1
        fit = Adam(n)
        for _ in range(STEPS // 2):
            bp, bu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
            zp, zu = (fit.w[b].sum(axis=1) + fit.w[-1] for b in (bp, bu))
            fit.step(_gradient(bp, _sigmoid(zp) - 1, n) + _gradient(bu, _sigmoid(zu), n) + DECAY * fit.w, RATE)
        self.bins, self.weights = bins, fit.w
        self.cuts = np.unique(np.quantile(fit.w[p].sum(axis=1), np.linspace(0.02, 0.8, 40)))

    def place(self, x: np.ndarray) -> np.ndarray:
        """How many cuts each row of features reaches."""
        return np.searchsorted(self.cuts, self.weights[self.bins(x)].sum(axis=1), "right")


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from how many rows of either kind reach 0, 1, ... cuts.

    The least ratio of shares above a cut with its standard error bounds it; few rows have a wide error, so
    that the bound is then near 1.
    """
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    above = lambda n, total: n[::-1].cumsum()[::-1][1:] / total
    share_p, share_u = above(positive, n_p), above(unlabelled, n_u)
    share_p, share_u = share_p[share_p > 0], share_u[share_p > 0]
    if not len(share_p):
        return 0.98
    ratio = share_u / share_p
    error = ratio * np.sqrt((1 - share_p) / (share_p * n_p) + (1 - share_u) / (np.maximum(share_u, 1 / n_u) * n_u)) + 1 / (n_u * share_p)
    return float(np.clip((ratio + error).min(), 0.02, 0.98))


class Model:
    """Bins and weights; without weights every text with words is good."""

    def __init__(self, bins: Binned | None, weights: np.ndarray | None, prior: float):
        self.bins, self.weights, self.prior = bins, weights, prior

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """g(x) of each document, positive for good ones; NaN if there is no model."""
        if self.weights is None:
            return np.full(len(offsets) - 1, np.nan)
        return self.weights[self.bins(features(data, offsets))].sum(axis=1) + self.weights[-1]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of being good, whether it is); NaN and False without words."""
        g = self.score(data, offsets)
        worded = np.diff(tk.Words(data, offsets).first) > 0
        p = np.where(worded, _sigmoid(g), np.nan)
        return p, worded & ~(g <= 0)


def nonnegative_risk(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk, its negative part) of a batch's sigmoids: ``prior * R+(p)`` and ``R-(u) - prior * R-(p)`` under the sigmoid loss."""
    negative = float(su.mean() - prior * sp.mean())
    return float(prior * (1 - sp).mean() + max(0.0, negative)), negative


def train(bins: Binned, p: np.ndarray, u: np.ndarray, prior: float, rng: np.random.Generator) -> Model:
    """Minimise the non-negative risk over rows of active coordinates."""
    n = int(bins.first[-1]) + 1
    fit = Adam(n)
    for _ in range(STEPS):
        bp, bu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        sp, su = (_sigmoid(fit.w[b].sum(axis=1) + fit.w[-1]) for b in (bp, bu))
        # sigmoid loss: l(z, +1) = sigmoid(-z), l(z, -1) = sigmoid(z)
        up, uu = sp * (1 - sp), su * (1 - su)
        if nonnegative_risk(sp, su, prior)[1] >= 0:
            gradient = _gradient(bp, -2 * prior * up, n) + _gradient(bu, uu, n)
        else:
            gradient = _gradient(bp, prior * up, n) - _gradient(bu, uu, n)
        fit.step(gradient + DECAY * fit.w, RATE)
    return Model(bins, fit.w, prior)


def _sampled(df: DataFrame, n: int, seed: int) -> DataFrame:
    """About ``n`` rows at most, by a hash of the id; all if there are fewer."""
    total = df.count()
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * n / total))


def _half(seed: int) -> Column:
    """The half of the ids by which the prior is counted; the other half fits the separating score."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 1


def _collect_features(df: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, half) of rows (id, t), ordered by a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, "t"):
            yield pa.record_batch([pa.array(list(features(data, offsets).astype(np.float32)), pa.list_(pa.float32())), *rows.columns[1:]], ["x", "half", "o"])

    found = df.select("t", _half(seed).alias("half"), F.xxhash64("id", F.lit(seed + 9)).alias("o")).mapInArrow(run, "x array<float>, half boolean, o long").toPandas().sort_values("o", kind="stable")
    return (np.stack(found["x"].to_numpy()).astype(np.float64), found["half"].to_numpy(bool)) if len(found) else (np.zeros((0, 1)), np.zeros(0, bool))


def count_prior(texts: DataFrame, trusted: DataFrame, separator: Separator, seed: int) -> float:
    """The class prior, counted over all rows (id, t) of the counting half: texts are scored where they lie, only (id, cuts reached) is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, "t"):
            yield pa.record_batch([rows.column(0), pa.array(separator.place(features(data, offsets)).astype(np.int32))], ["id", "k"])

    scored = texts.where(_half(seed)).select("id", "t").mapInArrow(run, "id long, k int")
    found = scored.join(trusted.withColumn("known", F.lit(1)), "id", "left").groupBy("known", "k").count().collect()
    n = np.zeros((2, len(separator.cuts) + 1), np.int64)
    for known, k, count in found:
        n[1, k] += count  # the unlabelled rows are all rows
        if known:
            n[0, k] += count
    return prior_of(n[0], n[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 5) -> Model:
    """Fit on documents and labels (doc_id, quality): quality 1 is a trusted positive, and all rows are the unlabelled ones."""
    trusted, at = cut(labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("id")).distinct())
    texts = docs.select(q(id_col).cast("long").alias("id"), q(text_col).alias("t")).where("t is not null and id is not null")
    positive, half_p = _collect_features(texts.join(F.broadcast(_sampled(trusted, sample, seed)), "id", "left_semi"), seed)
    unlabelled, half_u = _collect_features(_sampled(texts, sample, seed + 1), seed)
    if not len(positive) or not len(unlabelled):
        drop(docs.sparkSession, at)
        return Model(None, None, 1.0)
    rng = np.random.default_rng(seed)
    bins = Binned(np.concatenate([positive, unlabelled]))
    p, u = bins(positive), bins(unlabelled)
    fitted = lambda x, half: x[~half] if (~half).any() else x
    prior = count_prior(texts, trusted, Separator(bins, fitted(p, half_p), fitted(u, half_u), rng), seed)
    drop(docs.sparkSession, at)
    return train(bins, p, u, prior, rng)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, good) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, "t"):
            p, good = model.judge(data, offsets)
            yield pa.record_batch([rows.column(0), pa.array(p, mask=np.isnan(p)), pa.array(good)], ["doc_id", "score", "good"])

    return docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("t")).mapInArrow(run, "doc_id long, score double, good boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that aren't good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, text_col):
            yield rows.filter(pa.array(model.judge(data, offsets)[1]))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
