"""Best-fit packing of documents into fixed-size sequences by a grouping genetic algorithm.

A document of more tokens than ``capacity`` is cut into full pieces and a rest.  Pieces are spread over
shards of about ``SHARD`` pieces by hash.  Each shard is solved by several islands with other random
orders (one of them starts with best-fit decreasing, so the result is never worse).  In a generation,
crossover injects whole well-filled bins of one parent into the other, takes the duplicates out by
dissolving the bins that held them, and best-fits the displaced pieces, largest first.  After an epoch
each island's elite migrates to the next island of its shard; at the end the shard's best island wins.

Tokens are words plus one separator for each document, so every row of the table is packed, the null and
empty ones with their separator alone.  Rows are packed one by one, also equal ones and those without a
``doc_id``.  An empty table gives no bins; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import q, table
from brindle.storage import cut, drop

CAPACITY, SHARD, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2048, 4096, 4, 4, 3, 6
_WELL_FILLED = 0.995


def best_fit(sizes: list[int], fills: list[int], capacity: int) -> list[int]:
    """Place pieces in the given order into the bins (``fills`` grows) with the least room that suffices."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, fill in enumerate(fills):
        room = capacity - fill
        if room > 0 and fill >= 0:
            by_room.setdefault(room, []).append(b)
            mask |= 1 << room
    out = []
    for size in sizes:
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                mask ^= 1 << room
            fills[b] += size
            room -= size
        else:
            b, room = len(fills), capacity - size
            fills.append(size)
        if room:
            own = by_room.get(room)
            if own:
                own.append(b)
            else:
                by_room[room] = [b]
                mask |= 1 << room
        out.append(b)
    return out


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Falkenauer's: the mean square fill of the bins in use."""
    fill = np.bincount(bins, sizes)
    fill = fill[fill > 0] / capacity
    return float((fill**2).mean()) if len(fill) else 1.0


def _refit(bins: np.ndarray, out: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit the displaced pieces (mask ``out``), largest first, into the bins that are left."""
    bins = bins.copy()
    names, bins[~out] = np.unique(bins[~out], return_inverse=True)
    fills = np.bincount(bins[~out], sizes[~out], len(names)).astype(int).tolist()
    which = np.flatnonzero(out)
    which = which[np.argsort(-sizes[which], kind="stable")]
    bins[which] = best_fit(sizes[which].tolist(), fills, capacity)
    return bins


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``a`` with whole well-filled bins of ``b``."""
    fill = np.bincount(b, sizes)
    good = np.flatnonzero(fill >= min(_WELL_FILLED * capacity, np.quantile(fill, 0.7)))
    good = good[rng.random(len(good)) < rng.uniform(0.2, 0.6)]
    injected = np.isin(b, good)
    hurt = np.isin(a, np.unique(a[injected]))
    child = a + len(fill)
    child[injected] = b[injected]
    return _refit(child, hurt & ~injected, sizes, capacity)


def mutate(a: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the emptiest bins and a few others, and best-fit their pieces."""
    fill = np.bincount(a, sizes)
    n = max(2, len(fill) // 20)
    gone = np.concatenate([np.argsort(fill, kind="stable")[:n], rng.integers(0, len(fill), n)])
    return _refit(a, np.isin(a, gone), sizes, capacity)


def founders(sizes: np.ndarray, capacity: int, island: int, rng: np.random.Generator) -> list[np.ndarray]:
    out = []
    for k in range(POPULATION):
        noise = 0 if island == k == 0 else rng.normal(0, capacity / 64 * (1 + k), len(sizes))
        order = np.argsort(-(sizes + noise), kind="stable")
        bins = np.empty(len(sizes), np.int64)
        bins[order] = best_fit(sizes[order].tolist(), [], capacity)
        out.append(bins)
    return out


def epoch(population: list[np.ndarray], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Some generations of an island; the fittest come first."""
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for _ in range(GENERATIONS):
        a, b = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = mutate(crossover(scored[a][2], scored[b][2], sizes, capacity, rng), sizes, capacity, rng)
        scored.append((fitness(child, sizes, capacity), len(scored), child))
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:POPULATION]
        scored = [(f, k, p) for k, (f, _, p) in enumerate(scored)]
    return [p for _, _, p in scored]


def word_tokens(text: Column) -> Column:
    """White-space separated words and a separator."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)) + 1).cast("long")


def _run_epoch(capacity: int, n: int, last: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                sizes = np.frombuffer(r.sizes, np.int32).astype(np.int64)
                rng = np.random.default_rng([int(r.shard), int(r.island), n])
                if r.population is None:
                    people = founders(sizes, capacity, r.island, rng)
                else:
                    people = list(np.frombuffer(r.population, np.int32).astype(np.int64).reshape(-1, len(sizes)))
                people = epoch(people, sizes, capacity, rng)
                elite = people[0].astype(np.int32).tobytes()
                score = fitness(people[0], sizes, capacity)
                rows.append((r.shard, r.island, None if last else np.stack(people).astype(np.int32).tobytes(), elite, score))
            yield pd.DataFrame(rows, columns=["shard", "island", "population", "elite", "score"])

    return run


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            bins = np.frombuffer(r.elite, np.int32).astype(np.int64)
            yield pd.DataFrame({"shard": r.shard, "at": np.arange(len(bins)), "bin": bins})


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokens: Column | None = None) -> DataFrame:
    """(bin_id, doc_id, piece, n_tokens): which pieces share a sequence; pieces of a document count from 0."""
    spark = docs.sparkSession
    n_tokens = word_tokens(q(text_col)) if tokens is None else tokens
    lengths = docs.select(q(id_col).cast("long").alias("doc_id"), n_tokens.alias("n"))
    pieces = lengths.select("doc_id", "n", F.explode(F.expr(f"sequence(0, (n - 1) div {capacity})")).alias("piece")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.expr(f"n - piece * {capacity}")).cast("int").alias("n_tokens")
    )
    pieces, pieces_at = cut(pieces)
    shards = max(1, -(-pieces.count() // SHARD))
    ordered = F.sort_array(F.collect_list(F.struct("n_tokens", "doc_id", "piece")), asc=False)
    # The file's place of a row tells equal rows and those without an id apart; the table is written, so it is the same if a task is run again.
    salted = pieces.select("*", F.xxhash64("doc_id", "piece", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("salt"))
    items = salted.groupBy(F.pmod("salt", F.lit(shards)).alias("shard")).agg(ordered.alias("items"))
    items, items_at = cut(items)
    sizes = items.select("shard", F.col("items.n_tokens").alias("n")).mapInPandas(
        lambda frames: (pd.DataFrame({"shard": f["shard"], "sizes": [np.asarray(x, np.int32).tobytes() for x in f["n"]]}) for f in frames), "shard long, sizes binary"
    )
    sizes, sizes_at = cut(sizes)
    state = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("population", F.lit(None).cast("binary"))
    paths = []
    for n in range(EPOCHS):
        last = n == EPOCHS - 1
        # Rows of much work and few bytes: the number of partitions is set, lest they are put together by size.
        spread = state.repartition(max(1, min(-(-shards * ISLANDS // 8), 20_000)), "shard", "island")
        done, at = cut(spread.mapInPandas(_run_epoch(capacity, n, last), "shard long, island int, population binary, elite binary, score double"))
        paths.append(at)
        if not last:
            moved = done.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
            joined = done.join(moved, ["shard", "island"]).join(sizes, "shard")
            state = joined.select("shard", "sizes", "island", F.concat("population", "guest").alias("population"))
    won = done.groupBy("shard").agg(F.max_by("elite", F.struct("score", -F.col("island"))).alias("elite"))
    placed = items.select("shard", F.posexplode("items").alias("at", "item")).join(won.mapInPandas(_unpack, "shard long, at int, bin long"), ["shard", "at"])
    out, _ = cut(placed.select((F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("bin_id"), "item.doc_id", "item.piece", "item.n_tokens"))
    drop(spark, pieces_at, items_at, sizes_at, *paths)
    return out


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
