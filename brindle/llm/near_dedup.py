"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of hash tuples are drawn: ``A`` of ``a_size`` tuples of ``a_width`` minhashes and
``B`` of ``b_size`` tuples of ``b_width``.  Every pair (A_i, B_j) is a table, so ``a_size * b_size``
tables cost only ``a_size * a_width + b_size * b_width`` minhashes.  A pair with similarity J meets with
probability (1-(1-J^a_width)^a_size) * (1-(1-J^b_width)^b_size): at least 0.93 at the default threshold.

Candidates are verified by the Jaccard similarity of their whole shingle sets.  In each table every member
is compared with the smallest one.  For those that fail, an exact similarity join takes over: shingles are
ordered by a frequency sketch of ``SKETCH`` counters, rare ones first, and two sets that reach the threshold
share one of the first ``n - ceil(threshold * n) + 1`` of each (prefix filter; Chaudhuri et al., 2006), so what many
texts share, such as a template's frame, leads to no pair.  Pairs already in one component are left out.

Defined results: each distinct non-null ``doc_id`` gets one row (``doc_id``, ``group_id``), the group
being named by its smallest ``doc_id``.  Documents without words (null, empty or punctuation only) are
alone; rows that share a ``doc_id`` count as one document, any of whose texts may match.  Documents of
fewer words than a shingle have one shingle of all their words; very long ones count with all their shingles.
An empty table has no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import textkit as tk
from brindle.llm.common import BitFilter, having, q, table, without
from brindle.storage import cut, drop

SHINGLE, THRESHOLD, SKETCH = 3, 0.5, 1 << 20
A_SIZE, A_WIDTH, B_SIZE, B_WIDTH = 10, 2, 6, 1


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """(id, c, a, b): a content hash and the tuples of both collections, of documents that have words."""
    n_hashes = a[0] * a[1] + b[0] * b[1]
    rng = np.random.default_rng(20240229)
    mul = rng.integers(1, 1 << 63, n_hashes, dtype=np.uint64) * tk.U64(2) + tk.U64(1)
    add = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)

    def fold(mins: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(mins) // width, mins.shape[1]), np.uint64)
        for t in range(width):
            out = tk.mix(out * tk.U64(0x9E3779B97F4A7C15) + mins[t::width])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, "t"):
            s, first = tk.shingles(tk.Words(data, offsets), k)
            have = np.flatnonzero(np.diff(first))
            if not len(have):
                continue
            at = first[have]
            mins = np.empty((n_hashes, len(have)), np.uint64)
            for i in range(n_hashes):
                mins[i] = np.minimum.reduceat(s * mul[i] + add[i], at)
            mins = tk.mix(mins)
            c = tk.mix(np.add.reduceat(tk.mix(s), at) + np.diff(first)[have].astype(np.uint64))
            fa, fb = fold(mins[: a[0] * a[1]], a[1]), fold(mins[a[0] * a[1] :], b[1])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.T.reshape(-1).view(np.int64)), len(x)).cast(pa.list_(pa.int64())) for x in (fa, fb)]
            yield pa.record_batch([rows.column(0).take(pa.array(have)), pa.array(c.view(np.int64)), *lists], ["id", "c", "a", "b"])

    return docs.select(q(id_col).alias("id"), q(text_col).alias("t")).where("id is not null and t is not null").mapInArrow(tk.frugal(run), "id long, c long, a array<long>, b array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, s): sorted distinct 32-bit shingle hashes of rows (id, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.chunks(batches, "t"):
            s, first = tk.shingles(tk.Words(data, offsets), k)
            key = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first)) << tk.U64(32) | s >> tk.U64(32)
            key = np.unique(key)
            at = np.searchsorted(key, np.arange(len(first), dtype=np.uint64) << tk.U64(32))
            yield pa.record_batch([rows.column(0), tk.lists((key & tk.U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), at)], ["id", "s"])

    return docs.mapInArrow(tk.frugal(run), "id long, s array<int>")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) with their Jaccard similarity j and whether it reaches the threshold."""
    joined = pairs.join(sets.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v").join(sets.select(F.col("id").alias("u"), F.col("s").alias("su")), "u")
    common = F.size(F.array_intersect("su", "sv")).cast("double")
    j = common / (F.size("su") + F.size("sv") - common)
    return joined.select("u", "v", j.alias("j")).groupBy("u", "v").agg(F.max("j").alias("j")).withColumn("ok", F.col("j") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the vertices of edges (u, v): alternating large and small stars until nothing changes.

    A vertex's least neighbour is found by an aggregation and joined back, so that a hub's edges need not
    meet in one task.
    """
    spark = edges.sparkSession
    edges, at = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_at = cut(large)
        star = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        new = star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(star.select("u", F.col("m").alias("v"))).distinct()
        new, new_at = cut(new)
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        drop(spark, at, large_at)
        edges, at = new, new_at
        if now == seen and now[0] == now[2]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = now


def shared_keys(sig: DataFrame) -> DataFrame:
    """(key, id) of the tables of rows (id, a, b); a pair needs an ``a`` tuple that another row may share."""
    spark = sig.sparkSession
    tuples = sig.select(F.posexplode("a").alias("i", "x")).groupBy("i", "x").count().where("count > 1")
    mixed = lambda i, x: tk.mix(x ^ tk.mix(i.astype(np.uint64) + np.uint64(1)))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            i, x = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.record_batch([pa.array(mixed(i, x.view(np.uint64)).view(np.int64))], ["h"])

    shared, at = cut(tuples.select("i", "x").mapInArrow(hashes, "h long"))
    known = BitFilter(shared)
    drop(spark, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            a, b = (rows.column(k).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(rows.num_rows, -1) for k in (1, 2))
            ha = mixed(np.broadcast_to(np.arange(a.shape[1]), a.shape), a)
            row, i = np.nonzero(known.passes(ha.reshape(-1)).reshape(ha.shape))
            hb = mixed(np.broadcast_to(np.arange(b.shape[1]) + 1000, b.shape), b)
            keys = tk.mix(ha[row, i][:, None] * tk.U64(0x9E3779B97F4A7C15) + hb[row])
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), rows.column(0).take(pa.array(np.repeat(row, b.shape[1])))], ["key", "id"])

    return sig.select("id", "a", "b").mapInArrow(tk.frugal(run), "key long, id long")


def prefixes(sets: DataFrame, rank: np.ndarray, threshold: float, only: BitFilter | None = None) -> DataFrame:
    """(x, id, n): the rarest shingles of sets (id, s), one of which any set at the threshold shares, that may be in ``only``."""
    shared = sets.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            s, n = rows.column(1).flatten().to_numpy(zero_copy_only=False), np.diff(rows.column(1).offsets.to_numpy().astype(np.int64))
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((s, shared.value[s.view(np.uint32) & np.uint32(SKETCH - 1)], doc))
            place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            order = order[place < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[doc]]
            x, d = s[order].astype(np.int64), doc[order]
            if only is not None:
                keep = only.passes(tk.mix(x.view(np.uint64)).view(np.int64))
                x, d = x[keep], d[keep]
            yield pa.record_batch([pa.array(x), rows.column(0).take(pa.array(d)), pa.array(n[d])], ["x", "id", "n"])

    return sets.mapInArrow(tk.frugal(run), "x long, id long, n long")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, summed by the low bits of their hashes: ``SKETCH`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for rows in batches:
            total += np.bincount(rows.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint32) & np.uint32(SKETCH - 1), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    out = np.zeros(SKETCH, np.int64)
    found = sets.select("s").mapInArrow(tk.frugal(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def second_round(failed: DataFrame, sets: DataFrame, roots: DataFrame, judged: DataFrame, threshold: float) -> tuple[DataFrame, list[str]]:
    """Pairs (u, v) of documents of written ``failed`` (id) with others that can reach the threshold, in other components and not yet judged."""
    spark = sets.sparkSession
    rank = frequencies(sets)
    mine, mine_at = cut(prefixes(having(sets, F.col("id"), failed).join(failed, "id", "left_semi"), rank, threshold))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.record_batch([pa.array(tk.mix(rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))], ["h"])

    asked, asked_at = cut(mine.select("x").distinct().mapInArrow(hashes, "h long"))
    rooted = lambda rows: rows.join(roots, "id", "left").select("x", "id", "n", F.coalesce("root", "id").alias("root"))
    theirs, theirs_at = cut(rooted(prefixes(sets, rank, threshold, BitFilter(asked))))
    # A shingle whose documents are all in one component joins nothing.
    open_, open_at = cut(theirs.groupBy("x").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("x"))
    f, o = rooted(mine.join(open_, "x", "left_semi")).alias("f"), theirs.join(open_, "x", "left_semi").alias("o")
    alike = (F.least("f.n", "o.n") >= F.lit(threshold) * F.greatest("f.n", "o.n") - 1e-9) & (F.col("f.root") != F.col("o.root"))
    pairs = f.join(o, (F.col("f.x") == F.col("o.x")) & alike).select(F.least("f.id", "o.id").alias("u"), F.greatest("f.id", "o.id").alias("v")).distinct()
    apart, at = cut(pairs.join(judged.select("u", "v"), ["u", "v"], "left_anti"))
    drop(spark, mine_at, asked_at, theirs_at, open_at)
    return apart, [at]


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    a: tuple[int, int] = (A_SIZE, A_WIDTH),
    b: tuple[int, int] = (B_SIZE, B_WIDTH),
) -> tuple[DataFrame, str]:
    """(id, root) of the documents that belong to a group of two or more and are not its smallest, and the path of that table."""
    spark = docs.sparkSession
    sig, sig_at = cut(signatures(docs, id_col, text_col, shingle, a, b))
    reps, reps_at = cut(sig.groupBy("c").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    copies = sig.select("id", "c").join(reps.where("n > 1"), "c").where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v")).distinct()
    keys, keys_at = cut(shared_keys(sig.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub")
    stars = keys.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v"))
    pairs, pairs_at = cut(stars.unionAll(copies).distinct())
    involved, involved_at = cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    texts = docs.select(q(id_col).alias("id"), q(text_col).alias("t")).where("id is not null and t is not null")
    sets, sets_at = cut(shingle_sets(having(texts, F.col("id"), involved), shingle))
    judged, judged_at = cut(verify(pairs, sets, threshold))
    good = judged.where("ok").select("u", "v")
    failed, failed_at = cut(judged.where("not ok").select(F.col("v").alias("id")).distinct())
    paths = [sig_at, reps_at, keys_at, pairs_at, involved_at, sets_at, judged_at, failed_at]
    if not failed.isEmpty():
        roots, roots_at = cut(components(good))
        apart, more_paths = second_round(failed, sets, roots, judged, threshold)
        more, more_at = cut(verify(apart, sets, threshold).where("ok").select("u", "v"))
        good = good.unionAll(more)
        paths += [roots_at, *more_paths, more_at]
    out, at = cut(components(good))
    drop(spark, *paths)
    return out, at


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, group_id) of each distinct document."""
    roots, _ = near_groups(docs, id_col, text_col, **kw)
    ids = docs.select(q(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the documents that are not the smallest of their group."""
    roots, _ = near_groups(docs, id_col, text_col, **kw)
    return without(docs, id_col, roots.select("id"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
