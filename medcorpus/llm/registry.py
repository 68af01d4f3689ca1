"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("op01_packing", "op02_quality", "op03_near", "op04_substrings", "op05_licences", "op06_decontam", "op07_secrets", "op08_urls", "op09_chat", "op10_exact", "op11_tokens", "op12_audit", "op13_prefixes")


def _modules():
    return [importlib.import_module(f"medcorpus.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
