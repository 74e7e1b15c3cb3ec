"""The training-data pipeline: each stage's result is written as Parquet and read again by the next.

No SQL expresses the toxicity model, the near-duplicate groups or the packing, so ``ORACLE_SQL`` is None
and the stages are tested against brute force on small fixtures.  A stage decides by its whole input;
clean documents stay, with all their columns, until the last stage packs them.

Rows with null texts or ids pass every filter (a null text says nothing, and rows without an id are each
their own) and are packed with their separator alone.  Ties are resolved as the operators say: of equal texts
and of a group's documents the one with the smallest ``doc_id`` stays.  An empty table gives no rows, and
empty ``labels`` or ``benchmark`` remove nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from brindle.llm.common import table
from brindle.storage import cut, drop

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def remove_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact),
    ("near_dedup", remove_near),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, one after another; a stage's table goes once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, at = cut(stage(spark, docs, sf_dir))
        if before:
            drop(spark, before)
        before = at
    return docs
