"""Awkward documents that every operator must take."""

from collections import Counter

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "   \n\t ", "de"),
    (6, "?!...", "fr"),
    (None, "text of nobody", "en"),
    (None, None, None),
    (7, "one", "en"),
    (8, LONG, "en"),
    (9, "ñandú ÁÉÍ 日本語 🙂 mixed", "es"),
]
CLASH = ["id", "t", "h", "s", "text_", "hot", "batch", "spans", "brindle_gone", "brindle_h", "brindle_keep", "n", "keep_id", "score", "toxic", "c", "piece", "shard"]


def counted(df):
    return Counter(tuple(r) for r in df.collect())
