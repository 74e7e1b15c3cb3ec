"""Versioned tables: immutable Parquet files, listed by immutable manifests.

A commit writes a new manifest and then points ``CURRENT`` to it by an atomic rename, under a file lock, so
readers always see one whole version of all tables, and a snapshot is just an old manifest.  The root is a
folder that all executors share.  UPDATE and DELETE rewrite only the files that hold rows they touch.
"""

from __future__ import annotations

import contextlib
import copy
import fcntl
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import CorruptError, StorageError
from brindle.types import Schema


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root).absolute()
        for name in ("manifests", "data"):
            (self.root / name).mkdir(parents=True, exist_ok=True)
        if not (self.root / "CURRENT").exists():
            with self.lock():
                if not (self.root / "CURRENT").exists():
                    self._publish({"version": 0, "tables": {}, "changed": {}})

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        with open(self.root / "LOCK", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def _publish(self, manifest: dict) -> None:
        path = self.root / "manifests" / f"{manifest['version']:010}.json"
        for target, body in ((path, json.dumps(manifest)), (self.root / "CURRENT", str(manifest["version"]))):
            new = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
            with open(new, "w") as f:
                f.write(body)
                f.flush()
                os.fsync(f.fileno())
            os.replace(new, target)

    def current(self) -> dict:
        return self.manifest(int((self.root / "CURRENT").read_text()))

    def manifest(self, version: int) -> dict:
        try:
            return json.loads((self.root / "manifests" / f"{version:010}.json").read_text())
        except FileNotFoundError:
            raise StorageError(f"version {version} is gone") from None
        except ValueError:
            raise CorruptError(f"the manifest of version {version} is damaged") from None

    def commit(self, tables: dict, changed: dict[str, list[str]], base: dict) -> dict:
        """Publish tables as the version after ``base``, which the caller holds the lock on."""
        manifest = {"version": base["version"] + 1, "tables": tables, "changed": changed}
        self._publish(manifest)
        return manifest

    # files
    def write(self, df: DataFrame) -> list[str]:
        """Write a frame; the paths of its files below the root."""
        name = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"file://{self.root}/data/{name}")
        return sorted(str(p.relative_to(self.root)) for p in (self.root / "data" / name).glob("*.parquet"))

    def read(self, files: list[str], schema) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"file://{self.root}/{f}" for f in files])

    def relative(self, url: str) -> str:
        return str(Path(unquote(urlparse(url).path)).relative_to(self.root))

    def files_of(self, df: DataFrame, column: str) -> list[str]:
        """The files that a column of their addresses names."""
        return [self.relative(r[0]) for r in df.select(column).distinct().collect()]

    def files_with(self, df: DataFrame, condition) -> list[str]:
        """The files that hold a matching row; a list as long as the table's list of files at most."""
        found = df.where(condition).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
        return [self.relative(r["f"]) for r in found]

    def vacuum(self, pinned: set[int]) -> int:
        """Delete manifests and files that no version from the oldest pinned one on needs."""
        with self.lock():
            now = self.current()
            keep = set(range(min({now["version"], *pinned}), now["version"] + 1))
            used = set()
            for version in keep:
                m = self.manifest(version)
                used |= {f.split("/")[1] for t in m["tables"].values() for f in t["files"]}
                used |= {f.split("/")[1] for fs in m["changed"].values() for f in fs}
            for path in (self.root / "manifests").glob("*.json"):
                if int(path.stem) not in keep:
                    path.unlink()
            gone = [p for p in (self.root / "data").iterdir() if p.name not in used]
            for path in gone:
                shutil.rmtree(path)
            return len(gone)


class State:
    """A private copy of a manifest's tables that statements change; nothing is visible until it is committed."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.base = store, manifest
        self.tables: dict[str, dict] = copy.deepcopy(manifest["tables"])
        self.schemas: dict[str, Schema] = {}
        self.changed: dict[str, list[str]] = {}
        self.redefined: set[str] = set()

    def schema(self, table: str) -> Schema:
        if table not in self.schemas:
            self.schemas[table] = Schema.from_json(self.tables[table]["schema"])
        return self.schemas[table]

    def frame(self, table: str) -> DataFrame:
        return self.store.read(self.tables[table]["files"], self.schema(table).struct())

    def note(self, table: str, ids: DataFrame) -> None:
        """Remember which rows were touched."""
        self.changed.setdefault(table, []).extend(self.store.write(ids.select(F.col(ids.columns[0]).cast("string").alias("id"))))

    def changed_ids(self, files: list[str]) -> DataFrame:
        return self.store.read(files, "id string")

    def save_schema(self, table: str) -> None:
        self.tables[table]["schema"] = self.schema(table).to_json()
        self.redefined.add(table)
