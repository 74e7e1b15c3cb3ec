"""What the persisted indexes share: immutable segments, each over some of a table's files, and their notes.

A table is a list of immutable files, so what an index says of a file never changes.  A segment is a folder of
Parquet and a note that names the files it covers; the note is written last, so an unfinished segment is never
read.  Files that the table has no more are passed over until segments are merged.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.store import Store

MOST = 8


def file_of_row() -> Column:
    """The path below the root of the file that a row is read from."""
    return F.array_join(F.slice(F.split(F.col("_metadata.file_path"), "/"), -3, 3), "/")


class Segments:
    kind = ""

    def __init__(self, store: Store, table: str, column: str):
        self.store, self.spark = store, store.spark
        self.root = Path(store.root) / "index" / f"{table}.{column}.{self.kind}"

    def segments(self) -> dict[str, dict[str, Any]]:
        """The files that each segment covers, with what its kind of index notes of them."""
        return {p.stem: json.loads(p.read_text()) for p in self.root.glob("*.json")}

    def publish(self, rows: DataFrame, notes: dict[str, Any], by: str) -> None:
        """Write a segment sorted by ``by``, so that Parquet skips what a search does not ask for."""
        self.root.mkdir(parents=True, exist_ok=True)
        name = uuid.uuid4().hex
        rows.repartition(by).sortWithinPartitions(by).write.option("compression", "zstd").parquet(f"file://{self.root}/{name}")
        note = self.root / f".{name}"
        note.write_text(json.dumps(notes))
        os.replace(note, self.root / f"{name}.json")

    def uncovered(self, files: list[str]) -> list[str]:
        return sorted(set(files) - {f for notes in self.segments().values() for f in notes})

    def live(self, name: str, notes: dict[str, Any], files: set[str]) -> DataFrame:
        """A segment's rows of the files that the table still has."""
        rows, dead = self.spark.read.parquet(f"file://{self.root}/{name}"), [f for f in notes if f not in files]
        return rows.where(~F.col("file").isin(dead)) if dead else rows

    def merge(self, files: list[str], by: str) -> None:
        """Make one segment of all, if there are more than ``MOST``."""
        known, here = self.segments(), set(files)
        if len(known) <= MOST:
            return
        rows = None
        for name, notes in known.items():
            part = self.live(name, notes, here)
            rows = part if rows is None else rows.unionByName(part)
        self.publish(rows, {f: x for notes in known.values() for f, x in notes.items() if f in here}, by)
        for name in known:
            (self.root / f"{name}.json").unlink()
            shutil.rmtree(self.root / name)

    def drop(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)
