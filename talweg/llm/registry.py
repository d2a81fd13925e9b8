"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module that holds the function of that name.
MODULES = {
    "op1_quality_rules": "rules",
    "op2_token_counts": "tokencounts",
    "op3_quality_classifier": "quality",
    "op4_mix_to_targets": "mixing",
    "op5_suffix_array_dedup": "suffixdup",
    "op6_best_fit_packing": "packing",
    "op7_html_text": "htmltext",
    "op8_ngram_jaccard_join": "neardup",
    "op9_topk_search": "search",
    "op10_url_filter": "urlfilter",
    "op11_ranked_search": "ranked",
    "op12_hard_negatives": "hardneg",
    "op13_warc_assembly": "warc",
}
#: Query name -> module and name of its SQL.
ORACLE = {
    "op5_suffix_array_dedup": ("suffixdup", "OP5_SQL"),
    "op8_ngram_jaccard_join": ("neardup", "OP8_SQL"),
    "op9_topk_search": ("search", "OP9_SQL"),
    "op10_url_filter": ("urlfilter", "OP10_SQL"),
    "op11_ranked_search": ("ranked", "OP11_SQL"),
    "op12_hard_negatives": ("hardneg", "OP12_SQL"),
    "op13_warc_assembly": ("warc", "OP13_SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"talweg.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"talweg.llm.{module}"), text) for name, (module, text) in ORACLE.items()}
