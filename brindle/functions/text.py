"""Tokenising text for search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case tokens of letters and digits, of 2 to 64 bytes before they are lowered; null gives none."""
    raw = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(raw, lambda t: F.octet_length(t).between(2, 64)), F.lower)
