"""The ``opN_*`` queries and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ngram_join", "quality_rules", "secret_scan", "mixing", "warc", "bpe", "quality_model", "lm_score", "embedding_join", "packing", "spelling", "alignment", "topk_search")


def queries() -> dict:
    found = {}
    for m in MODULES:
        mod = import_module(f"riskloom.llm.{m}")
        found |= {k[2:]: f for k, f in vars(mod).items() if k.startswith("q_op") and f.__module__ == mod.__name__}
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for m in MODULES:
        found |= getattr(import_module(f"riskloom.llm.{m}"), "ORACLE", {})
    return found
