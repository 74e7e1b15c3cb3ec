"""Row changes and constraints as transformations of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.storage import cut


def update_rows(df: DataFrame, condition: Column | None, values: dict[str, Column]) -> DataFrame:
    """``df`` with columns set where the condition is TRUE."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete_rows(df: DataFrame, condition: Column | None) -> DataFrame:
    """The rows for which the condition isn't TRUE."""
    return df.limit(0) if condition is None else df.where(~F.coalesce(condition, F.lit(False)))


def arithmetic(col: Column, op: str, value: int | float, integer: bool) -> Column:
    """``col op value``: integers truncate in division and fail on overflow; a float result must be finite."""
    v = F.lit(value)
    if integer:
        v = v.cast("bigint")
        if op == "/":
            return F.when(v == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(F.call_function("div", col, v))
        wide = {"+": lambda: col.cast("decimal(38,0)") + v, "-": lambda: col.cast("decimal(38,0)") - v, "*": lambda: col.cast("decimal(19,0)") * v.cast("decimal(19,0)")}[op]()
        fits = wide.between(F.lit(-(1 << 63)).cast("decimal(20,0)"), F.lit("9223372036854775807").cast("decimal(20,0)"))
        return F.when(col.isNull(), F.lit(None)).when(fits, wide.cast("bigint")).otherwise(F.raise_error(F.lit("integer overflow")).cast("bigint"))
    v = v.cast("double")
    out = F.when(v == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(F.try_divide(col, v)) if op == "/" else {"+": lambda: col + v, "-": lambda: col - v, "*": lambda: col * v}[op]()
    return F.when(F.abs(out) == float("inf"), F.raise_error(F.lit("float overflow")).cast("double")).otherwise(out)


def insert_ignore(df: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The rows of ``new`` that may be inserted: the first of each key that ``df`` lacks; null keys always."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(order or key))
    first = new.withColumn("_rank", rank).where((F.col("_rank") == 1) | F.col(key).isNull()).drop("_rank")
    return first.join(df.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(*new.columns)


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the values that occur more than once; nulls are exempt."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, target: str) -> DataFrame:
    """Child rows whose non-null key the parent lacks."""
    keys = parent.select(F.col(target).alias("_key"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def referencing(child: DataFrame, column: str, doomed: DataFrame, target: str) -> DataFrame:
    """Child rows that refer to doomed parent rows."""
    keys = doomed.select(F.col(target).alias("_key"))
    return child.join(keys, F.col(column) == F.col("_key"), "left_semi")


def assign_identity(df: DataFrame, high: int, order: list[str | Column], column: str) -> DataFrame:
    """``df`` with the numbers after ``high`` in ``order``; rows that it leaves equal come in any order.

    Each partition of the sorted rows is numbered by itself and starts where the ones before it end, so no
    task sees all rows; the offsets are one number a partition.  The sorted rows are written once: a range
    partitioning that is made again has other bounds, and other partitions are joined in it.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows, _ = cut(sorted_.withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_p").withColumn(column, (F.lit(high) + F.col("_before") + F.col("_at") + 1).cast("bigint")).drop("_p", "_at", "_before")


def order_breaks(df: DataFrame, position: str, key: str) -> DataFrame:
    """(position) of rows whose key isn't above the one before.

    Compared within ranges of positions, and over their borders by the first and last row of each range; the
    ranges are written once, so that both see the same.
    """
    spread, _ = cut(df.select(F.col(position).alias("position"), F.col(key).alias("key")).repartitionByRange("position").withColumn("_p", F.spark_partition_id()))
    inner = spread.withColumn("before", F.lag("key").over(W.partitionBy("_p").orderBy("position"))).where(F.col("key") <= F.col("before")).select("position")
    ends = spread.groupBy("_p").agg(F.min_by("position", "position").alias("position"), F.min_by("key", "position").alias("key"), F.max_by("key", "position").alias("last"))
    border = ends.withColumn("before", F.lag("last").over(W.orderBy("_p"))).where(F.col("key") <= F.col("before")).select("position")
    return inner.unionByName(border)
