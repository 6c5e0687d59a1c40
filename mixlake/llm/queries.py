"""The subpackage's registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query and the module whose query() it is.
OPERATORS = {
    "op1_toxicity": "toxicity",
    "op2_nearest_neighbours": "ann",
    "op3_secret_scan": "secrets",
    "op4_quality_rules": "quality",
    "op5_license_scan": "licenses",
    "op6_token_output": "token_output",
    "op7_byte_bpe": "bpe",
    "op8_html_text": "html_text",
    "op9_mix_sources": "mixing",
    "op10_simhash_neardup": "simhash",
    "op11_centroid_clusters": "centroids",
    "op12_personal_data": "pii",
    "op13_spelling_variants": "spelling",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"mixlake.llm.{module}").query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in OPERATORS.items() if (sql := getattr(importlib.import_module(f"mixlake.llm.{module}"), "SQL", None))}
