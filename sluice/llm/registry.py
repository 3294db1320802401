"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sluice.llm import decontaminate, line_dedup, near_dups, packing, quality_rules, secret_scan, shards, suffix_dedup, token_store, window_dedup

_MODULES = {"op1_token_store": token_store, "op2_line_dedup": line_dedup, "op3_suffix_dedup": suffix_dedup, "op4_near_dups": near_dups, "op5_best_fit_packing": packing, "op6_sharding": shards, "op7_decontaminate": decontaminate, "op8_secret_scan": secret_scan, "op9_quality_rules": quality_rules, "op10_substring_dedup": window_dedup}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
