"""Queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

#: Query name: module that holds the function of that name, and its SQL if there is one.
_MODULES = {
    "op1_exact_dedup": "exact_dedup",
    "op2_quality_rules": "quality_rules",
    "op3_token_counts": "token_counts",
    "op4_line_dedup": "line_dedup",
    "op5_kd_sharding": "kd_sharding",
    "op6_source_mixing": "source_mixing",
    "op7_language_id": "language_id",
    "op8_best_fit_packing": "best_fit_packing",
    "op9_quality_classifier": "quality_classifier",
    "op10_simhash_dedup": "simhash_dedup",
    "op11_spelling_variants": "spelling_variants",
    "op12_exact_search": "exact_search",
    "op13_merkle_manifest": "merkle_manifest",
}


def queries() -> dict:
    return {name: getattr(import_module(f"lontar.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"lontar.llm.{module}"), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
