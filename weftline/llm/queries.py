"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name -> module of this package that defines it.
WHERE = {
    "op1_licenses": "licenses",
    "op2_language": "language",
    "op3_quality": "quality",
    "op4_mixing": "mixing",
    "op5_rules": "quality_rules",
    "op6_near_dups": "near_dups",
    "op7_secrets": "secret_scan",
    "op8_packing": "packing",
    "op9_token_store": "token_store",
    "op10_topk": "metric_tree",
    "op11_suffix_dedup": "suffixes",
    "op12_whitening": "whitening",
    "op13_clusters": "centroids",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"weftline.llm.{module}"), name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in WHERE.items():
        sql = getattr(importlib.import_module(f"weftline.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
