"""Structured Streaming into tables: every micro-batch is one commit, and is applied once.

The batch's number is kept in the manifest of the commit that holds its rows, so a batch that is run again
after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.engine import Engine, Writer
from brindle.operators.search import postings


def append_once(engine: Engine, table: str, df: DataFrame, stream: str, batch: int) -> bool:
    """Append a batch of a stream unless it was appended before."""

    def work(w: Writer) -> bool:
        w.table(table)
        done = w.state.tables[table].setdefault("streams", {})
        if batch <= done.get(stream, -1):
            return False
        w.append(table, df)
        done[stream] = batch
        return True

    return engine._change(work)


def stream_into(engine: Engine, table: str, stream: DataFrame, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a table; ``once`` takes what is there and ends."""
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: append_once(engine, table, df, name, n) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_postings(stream: DataFrame, id_col: str, text_col: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep a table of postings up to date with new documents; batches are directories, so a rerun replaces its own."""

    def write(df: DataFrame, n: int) -> None:
        postings(df, id_col, text_col).write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], window: str = "10 minutes", late: str = "1 hour", extra: Callable | None = None) -> DataFrame:
    """Counts by time window and keys, with a watermark for late rows."""
    timed = stream.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late)
    aggregates = [F.count(F.lit(1)).alias("n"), *([extra()] if extra else [])]
    return timed.groupBy(F.window("_at", window), *keys).agg(*aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
