"""A persisted equality index: which of a table's files hold a value, by its hash.

A lookup reads the entries of one hash and then only the files that they name, and those that no segment
covers yet.  Equal hashes of other values cost a file too many, never a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.segments import Segments, file_of_row


class EqualityIndex(Segments):
    kind = "equal"

    def catch_up(self, files: list[str], schema: T.StructType, key: str) -> None:
        new = self.uncovered(files)
        if new:
            rows = self.store.read(new, schema).where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"), file_of_row().alias("file"))
            self.publish(rows.distinct(), dict.fromkeys(new, 0), "h")
            self.merge(files, "h")

    def files_with(self, files: list[str], value: Column) -> list[str]:
        """The files that may hold ``value`` (a literal of the column's type)."""
        here, out = set(files), set(self.uncovered(files))
        for name, notes in self.segments().items():
            out |= {r[0] for r in self.live(name, notes, here).where(F.col("h") == F.xxhash64(value)).select("file").distinct().collect()}
        return sorted(out)
