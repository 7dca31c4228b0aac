"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_toxicity": "op1_toxicity",
    "op2_pii": "op2_pii",
    "op3_secrets": "op3_secrets",
    "op4_decontaminate": "op4_decontaminate",
    "op5_jaccard_join": "op5_jaccard_join",
    "op6_embedding_dedup": "op6_embedding_dedup",
    "op7_token_store": "op7_token_store",
    "op8_sentencepiece": "op8_sentencepiece",
    "op9_token_counts": "op9_token_counts",
    "op10_repeats": "op10_repeats",
    "op11_prefix_trie": "op11_prefix_trie",
    "op12_best_fit": "op12_best_fit",
    "op13_spellings": "op13_spellings",
}


def queries() -> dict:
    return {name: importlib.import_module(f"palisade.llm.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = ((name, getattr(importlib.import_module(f"palisade.llm.{module}"), "SQL", None)) for name, module in _MODULES.items())
    return {name: sql for name, sql in found if sql}
