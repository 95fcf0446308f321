"""The queries of the training-data operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: module with ``query(spark, sf_dir)`` and, where SQL can say it, ``ORACLE``.
MODULES = {
    "op1_decontaminate": "decontaminate",
    "op2_line_dedup": "line_dedup",
    "op3_sentencepiece": "sentencepiece_codec",
    "op4_near_dedup": "near_dedup",
    "op5_license_scan": "license_scan",
    "op6_quality_rules": "quality_rules",
    "op7_toxicity": "toxicity",
    "op8_quality_classifier": "quality_crf",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_token_store": "token_store",
    "op11_periodic_runs": "periodic_runs",
    "op12_substring_dedup": "suffix_trees",
    "op13_sort_means": "sort_means",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"siltstone.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"siltstone.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
