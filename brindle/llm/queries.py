"""The subpackage's queries, by operator number, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, exact_dedup, langid, near_dedup, packing, pii, quality, substring, token_codec, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_token_blocks": token_codec.op3_token_blocks,
    "op4_quality": quality.op4_quality,
    "op5_language": langid.op5_language,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_pii": pii.op8_pii,
    "op9_repeated_passages": substring.op9_repeated_passages,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES: dict[str, str] = {"op10_exact_dedup": exact_dedup.ORACLE}
