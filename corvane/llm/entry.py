"""The queries of the text operators and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_OPERATORS = {
    "op1_substring_dedup": "substring_dedup",
    "op2_bpe": "bpe",
    "op3_line_dedup": "line_dedup",
    "op4_token_files": "token_files",
    "op5_html_text": "html_text",
    "op6_decontamination": "decontaminate",
    "op7_near_dedup": "near_dedup",
    "op8_quality_classifier": "quality",
    "op9_token_counts": "token_counts",
    "op10_exact_dedup": "exact_dedup",
    "op11_vector_codes": "vector_codes",
    "op12_embedding_whitening": "whitening",
    "op13_simhash_dedup": "simhash",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"corvane.llm.{module}"), name) for name, module in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for module in _OPERATORS.values() for k, v in import_module(f"corvane.llm.{module}").SQL.items()}
