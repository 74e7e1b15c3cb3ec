"""Ranked search: BM25 over text, nearest neighbours over vectors, and both fused by reciprocal ranks.

All are DataFrame programs that end in a top-k, so only k rows leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import tokens
from brindle.functions.vectors import dequantize, distance, literal, quantize

K1, B, RRF = 1.2, 0.75, 60
#: Tokens that a Python worker counts at once, whatever a batch holds; a longer document comes alone.
TOKENS_AT_ONCE = 1 << 17
#: Queries and rows of a block of distances in a Python worker, and pairs of it whose distances are made again exactly at once.
TILE, _PAIRS = (256, 1024), 1 << 15


def materialised(text_col: str) -> Column:
    """The tokens of a column as a generator's output, so that no later use tokenises again."""
    return F.explode(F.array(tokens(F.col(text_col))))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    return [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query))))).collect()]


def postings(docs: DataFrame, id_col: str, text_col: str, *extra: str) -> DataFrame:
    """(term, id, tf, dl): the term counts and the length of each document, and ``extra`` columns.

    A document's tokens are in one row, so they are counted there, a bounded number at once: nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), *extra, materialised(text_col).alias("t")).where(F.size("t") > 0)
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema["id"], T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType()), *[rows.schema[x] for x in extra]])

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index("t"))
        n = np.diff(column.offsets.to_numpy().astype(np.int64))
        words = column.flatten().dictionary_encode()
        key = np.repeat(np.arange(len(n)), n) * max(1, len(words.dictionary)) + words.indices.to_numpy()
        key, tf = np.unique(key, return_counts=True)
        row = key // max(1, len(words.dictionary))
        at = pa.array(row)
        others = [batch.column(batch.schema.get_field_index(x)).take(at) for x in ("id", *extra)]
        return pa.record_batch([words.dictionary.take(pa.array(key % max(1, len(words.dictionary)))), others[0], pa.array(tf.astype(np.int32)), pa.array(n[row].astype(np.int32)), *others[1:]], ["term", "id", "tf", "dl", *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = batch.column(batch.schema.get_field_index("t")).offsets.to_numpy() if batch.num_rows else [], 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS_AT_ONCE, "right")) - 1)
                yield counted(batch.slice(at, to - at))
                at = to
            del batch, ends  # not beside the next one
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def _matching(record: Column | None) -> Column:
    return F.lit(True) if record is None else F.coalesce(record, F.lit(False))


def _gain(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def scored(rows: DataFrame, terms: list[str], n: int, avgdl: float, keep: DataFrame | None = None) -> DataFrame:
    """(id, score) from postings (term, id, tf, dl) of the query's terms, for a corpus of ``n`` documents."""
    seen = rows.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    rows = rows if keep is None else rows.join(keep, "id", "left_semi")
    gain = _gain(F.col("tf").cast("double"), F.col("df"), F.col("dl").cast("double"), F.lit(float(n)), F.lit(float(avgdl)))
    # As many rows as the query has terms: broadcast.  A fixed order of the terms makes equal scores equal.
    by_term = rows.join(F.broadcast(seen), "term").select("id", "term", gain.alias("gain"))
    pieces = [F.sum(F.when(F.col("term") == t, F.col("gain")).otherwise(0.0)).alias(f"g{k}") for k, t in enumerate(terms)]
    total = F.lit(0.0)
    for k in range(len(terms)):
        total = total + F.col(f"g{k}")
    return by_term.groupBy("id").agg(*pieces).select("id", total.alias("score"))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("t", lambda x: x == F.lit(term)))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, keep: Column | None = None) -> DataFrame:
    """(id, score) of the documents that hold a query term; statistics are those of the whole corpus.

    For texts without an index: each text is tokenised once a pass, one pass for the corpus figures and one
    for the documents that hold a term (no row a token).
    """
    terms = query_terms(docs.sparkSession, query)
    toks = docs.select(F.col(id_col).alias("id"), materialised(text_col).alias("t"), _matching(keep).alias("keep")).where(F.size("t") > 0)
    counts = [_occurrences(term).alias(f"f{k}") for k, term in enumerate(terms)]
    table = toks.select("id", "keep", F.explode(F.array(F.struct(F.size("t").cast("double").alias("dl"), *counts))).alias("x")).select("id", "keep", "x.*")
    stats = table.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"f{k}") > 0).cast("double")).alias(f"d{k}") for k in range(len(terms))])
    joined = table.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf = F.col(f"f{k}").cast("double")
        score = score + F.when(tf > 0, _gain(tf, F.col(f"d{k}"), F.col("dl"), F.col("n"), F.col("avgdl"))).otherwise(0.0)
    hit = F.greatest(F.lit(0), F.lit(0), *[F.col(f"f{k}") for k in range(len(terms))]) > 0
    return joined.where(hit & F.col("keep")).select("id", score.alias("score"))


def search_text(docs: DataFrame, id_col: str, text_col: str, query: str, top_k: int = 10, keep: Column | None = None) -> DataFrame:
    """The best documents (id, score), best first."""
    return bm25(docs, id_col, text_col, query, keep).orderBy(F.desc("score"), "id").limit(top_k)


def nearest(docs: DataFrame, id_col: str, vector_col: str, vector: list[float], top_k: int = 10, metric: str = "cosine", keep: Column | None = None) -> DataFrame:
    """The nearest vectors (id, distance), nearest first; exact.  The filter comes before the distances."""
    rows = docs.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(vector)) & _matching(keep))
    return rows.select(F.col(id_col).alias("id"), distance(F.col(vector_col), literal(vector), metric).alias("distance")).orderBy("distance", "id").limit(top_k)


def nearest_quantized(docs: DataFrame, id_col: str, vector_col: str, vector: list[float], top_k: int = 10, metric: str = "cosine", keep: Column | None = None) -> DataFrame:
    """The same with vectors of bytes: smaller to store, and approximate."""
    small = docs.where(F.col(vector_col).isNotNull() & _matching(keep)).select(F.col(id_col).alias("id"), dequantize(quantize(F.col(vector_col))).alias("v"))
    return nearest(small, "id", "v", vector, top_k, metric)


def fuse(ranked: list[DataFrame], top_k: int) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (id, rank from 0), ties by id.  The lists are bounded top-ks."""
    both = ranked[0]
    for other in ranked[1:]:
        both = both.unionByName(other)
    return both.groupBy("id").agg(F.sum(1.0 / (RRF + 1 + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id").limit(top_k)


def _ranked(top: DataFrame, *order: Column) -> DataFrame:
    return top.select("id", (F.row_number().over(W.orderBy(*order)) - 1).alias("rank"))


def search_hybrid(
    docs: DataFrame, id_col: str, top_k: int = 10, text: tuple[str, str] | DataFrame | None = None, vector: tuple[str, list[float], str] | None = None, keep: Column | None = None
) -> DataFrame:
    """(id, score) by reciprocal ranks of text ``(column, query)``, or its scores (id, score), and vector ``(column, vector, metric)`` search."""
    fetch, lists = max(4 * top_k, 50), []
    if text is not None:
        found = text.orderBy(F.desc("score"), "id").limit(fetch) if isinstance(text, DataFrame) else search_text(docs, id_col, text[0], text[1], fetch, keep)
        lists.append(_ranked(found, F.desc("score"), F.asc("id")))
    if vector:
        lists.append(_ranked(nearest(docs, id_col, vector[0], vector[1], fetch, vector[2], keep), F.asc("distance"), F.asc("id")))
    if not lists:
        raise ValueError("hybrid search needs a text or a vector query")
    return fuse(lists, top_k)


def ranking_quality(hits: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """One row of hit rate, recall, MRR and nDCG at k: hits (query_id, id, rank from 1), judgments (query_id, id)."""
    wanted = judgments.select("query_id", "id", F.lit(1).alias("good")).distinct()
    found = hits.where(F.col("rank") <= k).join(wanted, ["query_id", "id"], "left")
    by_query = found.groupBy("query_id").agg(F.sum(F.coalesce("good", F.lit(0))).alias("n"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("best"), F.sum(F.when(F.col("good") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    all_ = total.join(by_query, "query_id", "left").withColumn("ideal", F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.agg(F.avg((zero(F.col("n").cast("double")) > 0).cast("double")).alias("hit_rate"), F.avg(zero(F.col("n") / F.col("total"))).alias("recall"), F.avg(zero(1 / F.col("best"))).alias("mrr"), F.avg(zero(F.col("dcg") / F.col("ideal"))).alias("ndcg"))


def all_nearest(docs: DataFrame, id_col: str, vector_col: str, top_k: int = 10, metric: str = "cosine", queries: Column | None = None, slice_size: int = 4096, indexed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, distance, rank from 1) of the ``top_k`` nearest other vectors of every query; exact.

    ``queries`` says which rows are queries (all, if not given).  They go out in slices of ``slice_size``; for
    each, every task keeps the best of its own rows by one matrix product a batch, and these are merged, so
    the vectors themselves are never shuffled.  ``indexed`` are the vectors to search, if not ``docs``.
    """
    spark = docs.sparkSession
    ready = lambda df: df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    asked = ready(docs if queries is None else docs.where(F.coalesce(queries, F.lit(False))))
    rows = ready(docs if indexed is None else indexed)
    out = None
    for ids, vectors in _slices(asked, slice_size):
        sent = spark.sparkContext.broadcast((ids, vectors))
        part = rows.mapInArrow(_best_of(sent, top_k, metric), "query_id long, id long, distance double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k)


def _slices(asked: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, so many at a time."""
    ids, vectors = [], []
    for r in asked.orderBy("id").toLocalIterator():
        ids.append(r["id"])
        vectors.append(np.asarray(r["v"], np.float32))
        if len(ids) == size:
            yield np.array(ids, np.int64), np.stack(vectors)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.stack(vectors)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    product = a @ b.T
    if metric == "dot":
        return 1 - product
    if metric == "l2":
        return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * product, 0))
    length = np.sqrt((a**2).sum(1))[:, None] * np.sqrt((b**2).sum(1))[None]
    return np.where(length == 0, 1.0, 1 - product / np.where(length == 0, 1, length))


def _compared(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs what orders them, from one matrix product, and by how much rounding may have changed it."""
    product, aa, bb = a @ b.T, (a**2).sum(1)[:, None], (b**2).sum(1)[None]
    if metric == "l2":
        return aa + bb - 2 * product, 1e-12 * (aa + bb)
    length = np.sqrt(aa) * np.sqrt(bb)
    if metric == "dot":
        return 1 - product, 1e-12 * (1 + length)
    return np.where(length == 0, 1.0, 1 - product / np.where(length == 0, 1, length)), np.full((1, 1), 1e-12)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row by row; equal vectors have equal distances wherever they stand."""
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(1))
    product = (a * b).sum(1)
    if metric == "dot":
        return 1 - product
    length = np.sqrt((a**2).sum(1)) * np.sqrt((b**2).sum(1))
    return np.where(length == 0, 1.0, 1 - product / np.where(length == 0, 1, length))


def _best_of(sent, top_k: int, metric: str):
    """Tiles of ``TILE`` queries and rows are compared at once, whatever a batch holds; only rows that may be among the best are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, a = sent.value
        best_d, best_i = np.full((len(asked), top_k), np.inf), np.full((len(asked), top_k), np.iinfo(np.int64).max)
        for batch in batches:
            if not batch.num_rows:
                continue
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(all_ids), -1)
            for start in range(0, len(all_ids), TILE[1]):
                ids, b = all_ids[start : start + TILE[1]], vectors[start : start + TILE[1]].astype(np.float64)
                for at in range(0, len(asked), TILE[0]):
                    q = a[at : at + TILE[0]].astype(np.float64)
                    worst = best_d[at : at + len(q), -1:]
                    near, slack = _compared(q, b, metric)
                    near[asked[at : at + len(q), None] == ids[None]] = np.inf
                    most = (worst**2 if metric == "l2" else worst) + slack
                    if len(ids) > top_k:
                        # Of a tile no more than its own best, and what rounding may have put behind them.
                        most = np.minimum(most, np.partition(near + slack, top_k - 1, axis=1)[:, top_k - 1 : top_k] + slack)
                    row, col = np.nonzero((near <= most) & (near < np.inf))
                    for part in range(0, len(row), _PAIRS):
                        r, c = row[part : part + _PAIRS], col[part : part + _PAIRS]
                        _merge(best_d[at : at + len(q)], best_i[at : at + len(q)], r, _distances(q[r], b[c], metric), ids[c])
        keep = np.isfinite(best_d)
        yield pa.record_batch([pa.array(np.repeat(asked, top_k)[keep.ravel()]), pa.array(best_i[keep]), pa.array(best_d[keep])], ["query_id", "id", "distance"])

    return run


def _merge(best_d: np.ndarray, best_i: np.ndarray, row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
    """Put new (row, distance, id) among the best of their rows, in place."""
    touched, k = np.unique(row), best_d.shape[1]
    row, d, ids = np.concatenate([np.repeat(touched, k), row]), np.concatenate([best_d[touched].ravel(), d]), np.concatenate([best_i[touched].ravel(), ids])
    order = np.lexsort((ids, d, row))
    row, d, ids = row[order], d[order], ids[order]
    first = np.searchsorted(row, touched)[:, None] + np.arange(k)
    best_d[touched], best_i[touched] = d[first], ids[first]
