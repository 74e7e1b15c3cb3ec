"""Distances between vectors and their quantisation to bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """1 - cosine (1 where a vector has no length), 1 - dot product, or the Euclidean distance."""
    if metric == "dot":
        return 1 - dot(a, b)
    if metric == "l2":
        return F.sqrt(_fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    if metric == "cosine":
        length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(length == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / length)
    raise ValueError(f"unknown metric {metric!r}; use one of {', '.join(METRICS)}")


def quantize(vector: Column) -> Column:
    """A struct of the scale (largest magnitude / 127) and the rounded, clamped bytes."""
    scale = F.aggregate(vector, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x.cast("double")))) / 127
    q = F.transform(vector, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale)))).cast("tinyint"))
    return F.struct(scale.alias("scale"), q.alias("q"))


def dequantize(quantized: Column) -> Column:
    return F.transform(quantized.getField("q"), lambda x: x.cast("double") * quantized.getField("scale"))
