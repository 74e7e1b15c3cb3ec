"""A persisted inverted index: segments of postings sorted by term.

Files that no segment covers are indexed by the next search.  A search reads the postings of its terms only;
the corpus figures are in the segments' notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import search
from brindle.sources.segments import Segments, file_of_row


class TextIndex(Segments):
    kind = "text"

    def catch_up(self, files: list[str], schema: T.StructType, id_key: str, text_key: str) -> None:
        """Index the files that no segment covers, and merge if there are many segments."""
        new = self.uncovered(files)
        if not new:
            return
        rows = search.postings(self.store.read(new, schema).select(id_key, text_key, file_of_row().alias("file")), id_key, text_key, "file")
        sizes = self.store.read(new, schema).select(file_of_row().alias("file"), search.materialised(text_key).alias("t")).where(F.size("t") > 0)
        notes = {f: [0, 0] for f in new} | {r.file: [r.n, r.total] for r in sizes.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).alias("total")).collect()}
        self.publish(rows, notes, "term")
        self.merge(files, "term")

    def search(self, files: list[str], query: str, keep: DataFrame | None = None) -> DataFrame:
        """(id, score) of the documents of ``files`` that hold a term, and are in ``keep`` (id) if that is given."""
        here, terms, rows, n, total = set(files), search.query_terms(self.spark, query), None, 0, 0
        for name, notes in self.segments().items():
            part = self.live(name, notes, here).where(F.col("term").isin(terms)).drop("file")
            rows = part if rows is None else rows.unionByName(part)
            n += sum(x[0] for f, x in notes.items() if f in here)
            total += sum(x[1] for f, x in notes.items() if f in here)
        if rows is None or not n:
            return self.spark.createDataFrame([], "id string, score double")
        return search.scored(rows, terms, n, total / n, keep)


def top(scores: DataFrame, top_k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(top_k)


def kept(frame: DataFrame, id_key: str, condition: Column | None) -> DataFrame | None:
    """(id) of the rows that a filter leaves; None without one."""
    return None if condition is None else frame.where(F.coalesce(condition, F.lit(False))).select(F.col(id_key).alias("id"))
