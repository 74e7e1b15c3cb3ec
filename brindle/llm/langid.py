"""Language identification by Bayesian fusion of text, markup, address and host evidence.

Text: a naive Bayes model of hashed byte trigrams, fitted to at most about ``SAMPLE`` labelled rows a
language; its log likelihood is tempered by ``TEMPER``, as overlapping trigrams aren't independent.
Declared language and address suffix: the likelihood of each value given the language, counted over all
rows by grouped aggregation of text posteriors.  Host prior: language shares of the host's other rows,
smoothed towards those of its domain, these towards the whole table's; a row's own vote is taken out of
each level, so that nothing counts twice.  All evidence is added up as log odds.

The registered query judges ``pages`` (text without markup, declared ``lang``, address) and ``documents``
(text, with ``source`` in the place of the host) as one table.

Defined results: one row for each row of either table (``doc_id`` or ``page_id`` is null), with the most
probable language (the first in the alphabet of equals) and its probability.  Without text evidence the
rest decides; ``lang`` is null if a row has no trigrams, no declared language and no host, or if there are
no labelled rows.  Rows without ``lang`` are judged like others and teach nothing.  A script or comment that
is not closed takes the rest of its page.  Texts of any length are read whole; repeated ids are a row each
time; an empty table adds no rows; other columns are ignored.
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

SAMPLE, BITS, TEMPER, ALPHA_HOST, ALPHA_DOMAIN = 2_000, 15, 0.3, 5.0, 20.0
_TEXT_BYTE = np.zeros(256, np.uint64)
_TEXT_BYTE[[*range(65, 91)]] = np.arange(97, 123, dtype=np.uint64)
_TEXT_BYTE[[*range(97, 123)]] = np.arange(97, 123, dtype=np.uint64)
_TEXT_BYTE[128:] = np.arange(128, 256, dtype=np.uint64)
_TEXT_BYTE[39] = 39


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each document and where each begins; digits and marks count as spaces.

    Trigrams of spaces alone, and with a space in the middle, are left out.
    """
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    b = _TEXT_BYTE[data]
    key = (b[:-2] << tk.U64(16) | b[1:-1] << tk.U64(8) | b[2:]) * tk.U64(0x9E3779B97F4A7C15)
    keep = b[1:-1] > 0
    inner = offsets[1:-1]
    keep[inner[(inner >= 1) & (inner - 1 < n - 2)] - 1] = False
    keep[inner[(inner >= 2) & (inner - 2 < n - 2)] - 2] = False
    at = np.flatnonzero(keep)
    return (key[at] >> tk.U64(64 - BITS)).astype(np.int64), np.searchsorted(at, offsets)


class TextModel:
    """Log likelihoods of trigram buckets by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=0)).astype(np.float32) if len(languages) else np.zeros((1 << BITS, 0), np.float32)

    def likelihood(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tempered log likelihood by language, trigrams) of each document."""
        bucket, first = trigrams(data, offsets)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        full = np.flatnonzero(n)
        for k in range(len(self.languages)):
            if len(full):
                out[full, k] = np.add.reduceat(self.table[:, k][bucket], first[full], dtype=np.float64)
        return out * TEMPER, n


def fit_text(labelled: DataFrame, sample: int = SAMPLE, seed: int = 17) -> TextModel:
    """Fit on rows (id, t, lang), a hash sample of each language's."""
    spark = labelled.sparkSession
    sizes = {r["lang"]: r["count"] for r in labelled.where("t is not null and lang is not null").groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return TextModel([], np.zeros((1 << BITS, 0)))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, sample / n))))])
    picked = labelled.where("t is not null and lang is not null").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share[F.col("lang")])
    number = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        for rows, data, offsets in tk.chunks(batches, "t"):
            bucket, first = trigrams(data, offsets)
            lang = np.array([number[x] for x in rows.column(1).to_pylist()], np.int64)
            total += np.bincount(np.repeat(lang, np.diff(first)) << BITS | bucket, minlength=total.size).reshape(total.shape)
        k, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(k << BITS | bucket), pa.array(total[k, bucket])], ["at", "n"])

    found = picked.select("t", "lang").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts = np.zeros((len(languages) << BITS), np.float64)
    counts[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return TextModel(languages, counts.reshape(len(languages), -1).T)


def page_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, t, declared, host) of pages (page_id, url, html)."""
    html = F.col("html")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b(?:.*?</\1\s*>|.*\z)|<!--(?:.*?-->|.*\z)", " "), r"(?s)<[^>]*>|&[#a-zA-Z0-9]{1,9};", " ")
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})\b""", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text.alias("t"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))


def document_rows(docs: DataFrame) -> DataFrame:
    """The same of documents (doc_id, text, source): no markup, and the source is the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").alias("t"), none.alias("declared"), F.col("source").cast("string").alias("host"))


def _vector(values: list[Column]) -> Column:
    return F.array(*values)


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """(doc_id, page_id, lang, probability) of rows (doc_id, page_id, t, declared, host)."""
    spark, n = rows.sparkSession, len(model.languages)
    if not n:
        return rows.select("doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tk.chunks(batches, "t"):
            ll, grams = model.likelihood(data, offsets)
            top = np.maximum(ll - ll.max(axis=1, keepdims=True), -700)
            vote = np.exp(top)
            vote /= vote.sum(axis=1, keepdims=True)
            vote[grams == 0] = 0
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), n).cast(pa.list_(pa.float64())) for x in (top, vote)]
            names = ["doc_id", "page_id", "declared", "host"]
            yield pa.record_batch([*(part.column(part.schema.get_field_index(x)) for x in names), *lists], [*names, "ll", "vote"])

    scored = rows.mapInArrow(run, "doc_id long, page_id long, declared string, host string, ll array<double>, vote array<double>")
    address = F.col("host").contains(".")
    scored = scored.withColumn("suffix", F.when(address, F.substring_index("host", ".", -1))).withColumn("domain", F.when(address, F.substring_index("host", ".", -2)))
    scored, at = cut(scored)
    votes = [F.sum(F.col("vote")[k]).alias(f"v{k}") for k in range(n)]
    vector = lambda name: _vector([F.col(f"v{k}") for k in range(n)]).alias(name)
    whole = [float(x or 0.0) for x in scored.agg(*votes).first()]
    total = F.array(*[F.lit(x) for x in whole])
    paths = [at]

    def counts(key: str) -> DataFrame:
        out, path = cut(scored.where(F.col(key).isNotNull()).groupBy(key).agg(*votes).select(key, vector(f"{key}_votes")))
        paths.append(path)
        return out

    df = scored
    for key in ("host", "domain", "declared", "suffix"):
        df = df.join(counts(key), key, "left")
    values = {key: scored.select(key).where(F.col(key).isNotNull()).agg(F.approx_count_distinct(key)).first()[0] + 1.0 for key in ("declared", "suffix")}
    own = F.col("vote")
    zero = F.array(*[F.lit(0.0)] * n)
    rest = lambda votes_: F.zip_with(votes_, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)

    def smoothed(votes_: Column, parent: Column, alpha: float) -> Column:
        return F.zip_with(votes_, parent, lambda v, p: (v + alpha * p) / (size(votes_) + alpha))

    uniform = F.array(*[F.lit(1.0 / n)] * n)
    df = df.withColumn("g", smoothed(rest(total), uniform, 1.0 * n))
    df = df.withColumn("dv", F.coalesce(rest(F.col("domain_votes")), zero)).withColumn("d", smoothed(F.col("dv"), F.col("g"), ALPHA_DOMAIN))
    df = df.withColumn("hv", F.coalesce(rest(F.col("host_votes")), zero)).withColumn("prior", smoothed(F.col("hv"), F.col("d"), ALPHA_HOST))
    everyone = rest(total)

    def channel(key: str) -> Column:
        """log P(value | language), with the row's own vote taken out."""
        seen = F.zip_with(F.coalesce(rest(F.col(f"{key}_votes")), zero), everyone, lambda v, t: F.log((v + 0.5) / (t + 0.5 * values[key])))
        return F.when(F.col(key).isNotNull(), seen).otherwise(zero)

    logs = F.zip_with(F.zip_with("ll", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), F.zip_with(channel("declared"), channel("suffix"), lambda a, b: a + b), lambda a, b: a + b)
    df = df.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    names = F.array(*[F.lit(x) for x in model.languages])
    blank = (size(own) == 0) & F.col("declared").isNull() & F.col("host").isNull()
    lang = F.when(~blank, F.element_at(names, F.array_position("logs", F.col("top")).cast("int")))
    share = F.when(~blank, 1.0 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    out, _ = cut(df.select("doc_id", "page_id", lang.alias("lang"), share.alias("probability")))
    drop(spark, *paths)
    return out


def labelled_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return docs.select(q(id_col).alias("id"), q(text_col).alias("t"), q(lang_col).alias("lang"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = page_rows(table(spark, sf_dir, "pages")).unionByName(document_rows(docs))
    return identify(rows, fit_text(labelled_rows(docs)))
