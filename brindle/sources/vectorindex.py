"""A persisted inverted-file vector index: vectors as bytes, in cells around centroids, in immutable segments.

Centroids come from k-means over at most ``SAMPLE`` vectors; every vector of the table is then assigned to its
nearest one and written as bytes with a scale, sorted by cell, so that a search reads only the cells next to its
vector.  Segments cover files of the table like those of the text index.  When the table has grown to ``GROWN``
times what the centroids were made for, or there are more than ``MOST`` segments, the index is built anew.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.vectors import distance, literal
from brindle.operators.search import distances
from brindle.sources.store import Store

SAMPLE, CELL, MOST_CELLS, ROUNDS, MOST, GROWN = 20_000, 256, 4096, 12, 8, 4


def k_means(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Centroids of rows by Lloyd's rounds; an empty cell takes a random row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        at = nearest_cell(x, centres)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def nearest_cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((centres**2).sum(1)[None] - 2 * part @ centres.T).argmin(1) for part in np.array_split(x.astype(np.float64), 1 + len(x) // 4096)])


def to_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(int8 rows, scale of each): the largest magnitude is 127."""
    scale = np.abs(x).max(axis=1, initial=0).astype(np.float64) / 127
    return np.clip(np.rint(x / np.where(scale == 0, 1, scale)[:, None]), -127, 127).astype(np.int8), scale


class VectorIndex:
    def __init__(self, store: Store, table: str, column: str):
        self.store, self.spark = store, store.spark
        self.root = Path(store.root) / "index" / f"{table}.{column}.vectors"

    def _note(self) -> dict:
        path = self.root / "note.json"
        return json.loads(path.read_text()) if path.exists() else {"made_for": 0, "dim": 0, "segments": {}}

    def _publish(self, note: dict) -> None:
        new = self.root / f".{uuid.uuid4().hex}"
        new.write_text(json.dumps(note))
        os.replace(new, self.root / "note.json")

    def centres(self) -> np.ndarray:
        return np.load(self.root / self._note()["centres"])

    def catch_up(self, files: list[str], schema: T.StructType, id_key: str, vector_key: str) -> None:
        """Index the files that no segment covers."""
        self.root.mkdir(parents=True, exist_ok=True)
        note = self._note()
        new = sorted(set(files) - {f for fs in note["segments"].values() for f in fs["files"]})
        if not new:
            return
        rows = lambda some: self.store.read(some, schema).where(F.col(vector_key).isNotNull()).select(F.col(id_key).alias("id"), F.col(vector_key).cast("array<float>").alias("v"), F.array_join(F.slice(F.split(F.col("_metadata.file_path"), "/"), -3, 3), "/").alias("file"))
        n = rows(files).count()
        old = dict(note["segments"])
        if not note["made_for"] or n > GROWN * note["made_for"] or len(old) >= MOST:
            new, note = sorted(files), {"made_for": n, "segments": {}}
            share = min(1.0, SAMPLE / max(1, n))
            sample = [r[0] for r in rows(files).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * share)).select("v").collect()]
            x = np.array(sample, np.float32) if sample else np.zeros((1, 1), np.float32)
            note["centres"] = f"{uuid.uuid4().hex}.npy"
            note["dim"] = x.shape[1] if sample else 0
            np.save(self.root / note["centres"], k_means(x, min(len(x), MOST_CELLS, max(1, n // CELL))))
        if n:
            name = uuid.uuid4().hex
            assigned = rows(new).mapInArrow(_assigned(np.load(self.root / note["centres"])), T.StructType([T.StructField("cell", T.IntegerType()), rows(new).schema["id"], T.StructField("q", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("file", T.StringType())]))
            assigned.repartition("cell").sortWithinPartitions("cell").write.option("compression", "zstd").parquet(f"file://{self.root}/{name}")
            note["segments"][name] = {"files": new}
            self._publish(note)
        for name in set(old) - set(note["segments"]):
            shutil.rmtree(self.root / name, ignore_errors=True)

    def search(self, files: list[str], vector: list[float], candidates: int, metric: str, probes: int | None = None, keep: DataFrame | None = None) -> DataFrame:
        """(id, distance) of the nearest ``candidates`` by bytes, of the cells nearest to the vector."""
        note, live = self._note(), set(files)
        x = np.asarray(vector, np.float32)[None]
        if not note["segments"] or note["dim"] != x.shape[1]:
            return self.spark.createDataFrame([], "id string, distance double")
        centres = np.load(self.root / note["centres"])
        order = np.argsort(distances(x, centres, metric)[0], kind="stable")[: probes or max(8, len(centres) // 8)].tolist()
        rows = None
        for name, segment in note["segments"].items():
            part, dead = self.spark.read.parquet(f"file://{self.root}/{name}").where(F.col("cell").isin(order)), [f for f in segment["files"] if f not in live]
            part = part.where(~F.col("file").isin(dead)) if dead else part
            rows = part if rows is None else rows.unionByName(part)
        rows = rows if keep is None else rows.join(keep, "id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1)
                    y = q * batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                    yield pa.record_batch([batch.column(0), pa.array(distances(x, y, metric)[0])], ["id", "distance"])

        found = rows.select("id", "q", "scale").mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("distance", T.DoubleType())]))
        return found.orderBy("distance", "id").limit(candidates)

    def drop(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                q, scale = to_bytes(x)
                yield pa.record_batch([pa.array(nearest_cell(x, centres).astype(np.int32)), batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), batch.column(2)], ["cell", "id", "q", "scale", "file"])

    return run


def rescored(frame: DataFrame, id_key: str, vector_key: str, found: DataFrame, vector: list[float], top_k: int, metric: str) -> DataFrame:
    """(id, distance) of the best candidates by their own vectors; the candidates are a bounded list."""
    ids = F.broadcast(found.select(F.col("id").alias(id_key)))
    exact = frame.join(ids, id_key, "left_semi").select(F.col(id_key).alias("id"), distance(F.col(vector_key), literal(vector), metric).alias("distance"))
    return exact.orderBy("distance", "id").limit(top_k)
