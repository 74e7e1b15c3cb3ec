"""Pieces that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class BitFilter:
    """Which 64-bit hashes may be in a set: four bits each in one array, shared with the Python workers.

    There are 16 bits or more for each member (one stranger in 400 passes) while that is at most ``most``
    bits; a larger set only lets more strangers pass.  So a filter never decides alone: it keeps rows out of
    a shuffle that would find nothing for them, and the join behind it is the same at every size.
    """

    def __init__(self, hashes: DataFrame, most: int = 1 << 29):
        """``hashes`` is a written table with one column of longs."""
        (name,) = hashes.columns
        self.bits = max(1 << 15, min(most, 1 << (16 * hashes.count()).bit_length()))
        places = F.explode(F.array(*(F.pmod(F.shiftright(name, s) if s else F.col(name), F.lit(self.bits)) + 1 for s in self.SHIFTS)))
        place = hashes.where(F.col(name).isNotNull()).select(places.alias("x"))
        pages = place.groupBy(F.bitmap_bucket_number("x").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
        table = np.zeros(self.bits // 8, np.uint8)
        for page, bits in pages.toLocalIterator():
            table[(page - 1) * 4096 : page * 4096] = np.frombuffer(bits, np.uint8)
        self.shared = hashes.sparkSession.sparkContext.broadcast(table)

    SHIFTS = (0, 11, 23, 34)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "shared": self.shared}

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out, table = np.ones(len(hashes), bool), self.shared.value
        at = np.arange(len(hashes))
        for s in self.SHIFTS:
            place = (hashes.view(np.int64)[at] >> s) & np.int64(self.bits - 1)
            miss = (table[place >> 3] >> (place & 7).astype(np.uint8) & 1) == 0
            out[at[miss]] = False
            at = at[~miss]
        return out

    def may(self, h: Column) -> Column:
        """Whether a column of longs passes; only that column goes to Python, the row stays.  Nulls do not pass."""

        @F.arrow_udf("boolean")
        def test(x: pa.Array) -> pa.Array:
            return pa.array(self.passes(x.to_numpy(zero_copy_only=False)))

        return h.isNotNull() & test(F.coalesce(h, F.lit(0)))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions ``path/v=N``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [x.getPath() for x in fs.listStatus(at)]
    return [int(x.getName()[2:]) for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]


def hashed(id_: Column) -> Column:
    return F.xxhash64(id_)


def having(docs: DataFrame, id_: Column, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be among the written ``ids`` (one column); whoever joins them drops the rest."""
    return docs.where(BitFilter(ids.select(hashed(F.col(ids.columns[0])).alias("h"))).may(hashed(id_)))


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is among the written ``gone`` (one column).  Only rows that may be go through a join."""
    (name,) = fresh(docs, "brindle_gone")
    maybe = BitFilter(gone.select(hashed(F.col(gone.columns[0])).alias("h"))).may(hashed(q(id_col)))
    judged = docs.where(maybe).join(gone.toDF(name), q(id_col) == F.col(name), "left_anti")
    return docs.where(~maybe).unionAll(judged)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have in any case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
