"""Exact deduplication with a cuckoo-filter index (Fan et al., 2014).

A digest is live while some document carries it.  Each part of the digest space is a cuckoo table whose
buckets hold the digests and how many rows carry them, so insertion and deletion touch two buckets, hits
are verified there, and a table that overflows is rebuilt at twice the size from its stored keys.  The
documents are inserted; the texts of digests with several carriers are then compared themselves.

Defined results: a null text is no content, so it is kept and never a duplicate; the empty text is
content like any other.  Of equal texts the row with the smallest ``doc_id`` is kept; rows without a
``doc_id`` yield to those with one.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import BitFilter, fresh, q, table, versions
from brindle.llm.textkit import U64, mix
from brindle.storage import cut, drop, scratch

SLOTS = 4
_MAX_KICKS = 256


class LiveDigests:
    """Live digests with their number of carriers, in a cuckoo table: 16-bit fingerprints in buckets of four.

    Beside each fingerprint its bucket holds the 64-bit key, 16 further bytes of content digest and the
    carriers.  A fingerprint that hits is verified against what its bucket holds, so an operation touches two
    buckets however many keys there are.  A table that overflows is rebuilt at twice the size from its keys.
    """

    FIELDS = (("fp", np.uint16), ("key", np.int64), ("more", np.int64), ("most", np.int64), ("n", np.int64))

    def __init__(self, capacity: int = 256, raw: bytes | None = None):
        if raw is not None:
            slots = len(raw) // sum(np.dtype(t).itemsize for _, t in self.FIELDS)
            at = 0
            for name, kind in self.FIELDS:
                setattr(self, name, np.frombuffer(raw, kind, slots, at).reshape(-1, SLOTS).copy())
                at += slots * np.dtype(kind).itemsize
        else:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
            for name, kind in self.FIELDS:
                setattr(self, name, np.zeros((buckets, SLOTS), kind))
        self._rng = np.random.default_rng(7)

    def __len__(self) -> int:
        return int((self.fp != 0).sum())

    def raw(self) -> bytes:
        return b"".join(getattr(self, name).tobytes() for name, _ in self.FIELDS)

    def entries(self) -> tuple[np.ndarray, ...]:
        """(key, more, most, n) of all live digests."""
        live = self.fp != 0
        return tuple(getattr(self, name)[live] for name, _ in self.FIELDS[1:])

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(key.view(U64))
        fp = (h >> U64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        one = (h & U64(len(self.fp) - 1)).astype(np.int64)
        return fp, one, self._other(one, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(fp.astype(U64)) & U64(len(self.fp) - 1)).astype(np.int64)

    def _find(self, key: np.ndarray, more: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The slot of each digest (bucket * SLOTS + place), -1 if it is not live."""
        fp, one, two = self._places(key)
        out = np.full(len(key), -1, np.int64)
        for bucket in (one, two):
            hit = np.flatnonzero((self.fp[bucket] == fp[:, None]).any(axis=1) & (out < 0))
            at = bucket[hit]
            same = (self.fp[at] == fp[hit, None]) & (self.key[at] == key[hit, None]) & (self.more[at] == more[hit, None]) & (self.most[at] == most[hit, None])
            found = same.any(axis=1)
            out[hit[found]] = at[found] * SLOTS + same[found].argmax(axis=1)
        return out

    def lookup(self, key: np.ndarray, more: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The carriers of each digest, 0 if it is not live."""
        at = self._find(key, more, most)
        return np.where(at >= 0, self.n.reshape(-1)[np.maximum(at, 0)], 0)

    def insert(self, key: np.ndarray, more: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Add ``n`` carriers to each of distinct digests; returns how many each had before."""
        at = self._find(key, more, most)
        live = at >= 0
        before = np.where(live, self.n.reshape(-1)[np.maximum(at, 0)], 0)
        self.n.reshape(-1)[at[live]] += n[live]
        new = tuple(x[~live] for x in (key, more, most, n))
        if len(self) + len(new[0]) > self.fp.size * 0.9 or not self._put(new):
            self._rebuild(new)
        return before

    def delete(self, key: np.ndarray, more: np.ndarray, most: np.ndarray, n: np.ndarray) -> None:
        """Take carriers from distinct digests; one without any leaves its bucket."""
        at = self._find(key, more, most)
        at, n = at[at >= 0], n[at >= 0]
        left = self.n.reshape(-1)
        left[at] -= n
        gone = at[left[at] <= 0]
        for name, _ in self.FIELDS:
            getattr(self, name).reshape(-1)[gone] = 0

    def _rebuild(self, new: tuple[np.ndarray, ...]) -> None:
        """Twice the size or more, from the stored keys and the ``new`` ones."""
        every = tuple(np.concatenate(x) for x in zip(self.entries(), new))
        capacity = max(2 * self.fp.size, int(len(every[0]) / 0.45))
        while True:
            self.__init__(capacity)
            if self._put(every):
                return
            capacity *= 2

    def _put(self, new: tuple[np.ndarray, ...]) -> bool:
        """Place distinct new digests; False, and the table as it was, if it overflowed."""
        if not len(new[0]):
            return True
        saved = {name: getattr(self, name).copy() for name, _ in self.FIELDS}
        fp, one, two = self._places(new[0])
        rest = self._place([fp, *new], one)
        rest, bucket = [x[rest] for x in [fp, *new]], two[rest]
        for _ in range(_MAX_KICKS):
            left = self._place(rest, bucket)
            rest, bucket = [x[left] for x in rest], bucket[left]
            if not len(bucket):
                return True
            head = np.unique(bucket, return_index=True)[1]  # one eviction a bucket and round
            slot = self._rng.integers(0, SLOTS, len(head))
            for (name, _), mine in zip(self.FIELDS, rest):
                mine[head], getattr(self, name)[bucket[head], slot] = getattr(self, name)[bucket[head], slot].copy(), mine[head].copy()
            bucket[head] = self._other(bucket[head], rest[0][head])
        for name, old in saved.items():  # as it was before, so that nothing evicted is lost
            setattr(self, name, old)
        return False

    def _place(self, new: list[np.ndarray], bucket: np.ndarray) -> np.ndarray:
        """Put digests into free slots of their buckets; returns the mask of those that found none."""
        left = np.ones(len(bucket), bool)
        if not len(bucket):
            return left
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.r_[True, b[1:] != b[:-1]]
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
        free = self.fp[b] == 0
        fits = rank < free.sum(axis=1)
        slot = (free & (np.cumsum(free, axis=1) == (rank + 1)[:, None])).argmax(axis=1)
        for (name, _), mine in zip(self.FIELDS, new):
            getattr(self, name)[b[fits], slot[fits]] = mine[order[fits]]
        left[order[fits]] = False
        return left


def digests(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """A 64-bit key and 16 bytes of SHA-256 of the text, as longs."""
    sha = F.sha2(q(text_col).cast("binary"), 256)
    part = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("long")
    return [F.xxhash64(q(text_col)).alias("h"), part(1).alias("c"), part(16).alias("d")]


class CuckooIndex:
    """A persistent index of live digests below ``path``, one version a change; it reopens from the path.

    Digests are spread over parts, one cuckoo table each.  ``insert`` adds carriers (rows with a text) and
    answers which digests had carriers before or have several now; ``delete`` takes carriers away again, and a
    digest is live until its last one is gone.  Parts that would hold more than ``PART`` digests on average
    are split by doubling their number, from the stored keys.  The version before the last stays for readers.
    """

    PART = 1 << 20
    SCHEMA = "part int, parts int, live binary, h long, c long, d long, n long"

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = 0):
        self.spark, self.path = spark, path or scratch(spark, "cuckoo")
        self.parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.version = max(versions(spark, self.path), default=-1)
        if self.version < 0:
            self._write(spark.createDataFrame([], self.SCHEMA))
        else:
            had = self.state().select(F.max("parts")).first()[0]
            self.parts = had or self.parts

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v={self.version + 1}")
        self.version += 1
        drop(self.spark, f"{self.path}/v={self.version - 2}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v={self.version}")

    def state(self) -> DataFrame:
        return self.rows().where("live is not null").select("part", "parts", "live")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("h"), F.lit(self.parts)).cast("int").alias("part")

    def _keyed(self, docs: DataFrame, text_col: str) -> DataFrame:
        """(h, c, d, n) of the texts: equal ones are counted before the shuffle."""
        return docs.where(q(text_col).isNotNull()).select(*digests(docs, text_col)).groupBy("h", "c", "d").agg(F.count(F.lit(1)).alias("n"))

    def _split(self, more: int) -> None:
        total = self.rows().where("live is not null").select(F.sum(F.length("live"))).first()[0] or 0
        while total / 34 / 2 + more > self.PART * self.parts:
            self.parts *= 2

    def _advance(self, keyed: DataFrame, remove: bool) -> DataFrame:
        """Write the next version; (h, c, d, n) of the digests with several carriers, if added to."""
        keyed, at = cut(keyed)
        had = self.parts
        if not remove:
            self._split(keyed.count())
        state = self.state()
        if self.parts != had:  # stored digests go to their new parts

            def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for raw in frame["live"]:
                        yield pd.DataFrame(dict(zip("hcdn", LiveDigests(raw=raw).entries())))

            keyed = keyed.withColumn("old", F.lit(False)).unionByName(state.mapInPandas(spread, "h long, c long, d long, n long").withColumn("old", F.lit(True)))
            state = state.where("false")
        else:
            keyed = keyed.withColumn("old", F.lit(False))
        parts = self.parts

        def step(key: tuple, state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            live = LiveDigests(raw=state["live"].iloc[0]) if len(state) else LiveDigests()
            old = rows["old"].to_numpy(bool) if len(rows) else np.zeros(0, bool)
            columns = tuple(rows[x].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64) for x in "hcdn")
            if old.any():
                live.insert(*(x[old] for x in columns))
            columns = tuple(x[~old] for x in columns)
            if remove:
                live.delete(*columns)
                hit = np.zeros(0, np.int64)
            else:
                n = live.insert(*columns) + columns[3]
                hit = np.flatnonzero(n > 1)
            out = {x: pd.Series([None, *y[hit]], dtype="Int64") for x, y in zip("hcd", columns)}
            out["n"] = pd.Series([None, *(n[hit] if len(hit) else [])], dtype="Int64")
            return pd.DataFrame({"part": key[0], "parts": parts, "live": [live.raw(), *[None] * len(hit)], **out})

        keyed = keyed.withColumn("part", self._part())
        self._write(state.groupBy("part").cogroup(keyed.groupBy("part")).applyInPandas(step, self.SCHEMA))
        drop(self.spark, at)
        return self.rows().where("live is null").select("h", "c", "d", "n")

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, live) of the rows with a text: the table's hits, verified against what the buckets hold."""

        def probe(key: tuple, state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({x: pd.Series(dtype="int64") for x in "hcdn"})
            columns = tuple(rows[x].to_numpy(np.int64) for x in "hcd")
            n = LiveDigests(raw=state["live"].iloc[0]).lookup(*columns) if len(state) else np.zeros(len(rows), np.int64)
            return pd.DataFrame(dict(zip("hcd", columns)) | {"n": n})

        keyed = self._keyed(docs, text_col).withColumn("part", self._part())
        found = self.state().groupBy("part").cogroup(keyed.groupBy("part")).applyInPandas(probe, "h long, c long, d long, n long")
        rows = docs.where(q(text_col).isNotNull()).select(q(id_col).alias("doc_id"), *digests(docs, text_col))
        return rows.join(found, ["h", "c", "d"]).select("doc_id", (F.col("n") > 0).alias("live"))

    def insert(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Add the rows' texts; (h, c, d, n) of their digests with several carriers by now."""
        return self._advance(self._keyed(docs, text_col), remove=False)

    def delete(self, docs: DataFrame, text_col: str = "text") -> None:
        """Take the rows' texts out, a carrier each."""
        self._advance(self._keyed(docs, text_col), remove=True)


def repeated(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """(h, c, d, n) of the digests that several rows carry, and the path of the index that says so."""
    index = CuckooIndex(docs.sparkSession)
    return index.insert(docs, text_col), index.path


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, n_copies, is_duplicate) of each row."""
    spark = docs.sparkSession
    hits, path = repeated(docs, text_col)
    maybe = BitFilter(hits.select("h")).may(F.xxhash64(q(text_col)))
    rows = docs.select(q(id_col).alias("doc_id"), q(text_col).alias("t"), *digests(docs, text_col))
    # The texts of repeated digests decide; equal ones are combined before the shuffle, so a hot text costs one row a task.
    groups = docs.where(q(text_col).isNotNull() & maybe).select(q(id_col).alias("id"), q(text_col).alias("t")).groupBy("t").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    groups, groups_at = cut(groups.select(*digests(docs, "t"), "keep_id", "n_copies"))
    marked = rows.drop("t").join(groups, ["h", "c", "d"], "left")
    out, _ = cut(
        marked.select(
            "doc_id",
            F.coalesce("keep_id", "doc_id").alias("keep_id"),
            F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
            F.coalesce(~F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("n_copies").isNotNull(), F.lit(False)).alias("is_duplicate"),
        )
    )
    drop(spark, path, groups_at)
    return out


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each text; of rows that repeat the kept ``doc_id`` and text any stays.

    Rows whose digest has no other carrier stay where they lie; the others are grouped by their text, and
    each group's kept row is chosen before the shuffle in every task and once more behind it.
    """
    spark = docs.sparkSession
    hits, path = repeated(docs, text_col)
    maybe = BitFilter(hits.select("h")).may(F.xxhash64(q(text_col)))
    drop(spark, path)
    alone = docs.where(q(text_col).isNull() | ~maybe)
    row, place = fresh(docs, "brindle_row", "brindle_place")
    rest = docs.where(q(text_col).isNotNull() & maybe).select(q(text_col).alias(place), F.struct(*map(q, docs.columns)).alias(row), q(id_col).alias("brindle_id"))
    kept = rest.groupBy(place).agg(F.min_by(row, F.struct(F.col("brindle_id").isNull(), "brindle_id")).alias(row))
    return alone.unionAll(kept.select(*(F.col(row).getField(c).alias(c) for c in docs.columns)))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE coalesce(min(doc_id) OVER (PARTITION BY text), doc_id) END AS keep_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS n_copies,
       text IS NOT NULL AND doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY text) AND count(*) OVER (PARTITION BY text) > 1 AS is_duplicate
FROM documents
"""
