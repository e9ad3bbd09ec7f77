"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("toxicity", "near_dedup", "class_lm", "quality", "license_scan", "packing", "decontaminate", "embed_dedup", "sharding", "secrets",
           "html_text", "hard_negatives", "periodic_runs")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"logvault.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"logvault.llm.{m}").ORACLE_SQL.items()}
