"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import importlib

MODULES = ["language", "quality", "decontaminate", "pii", "tokens", "mixing", "substring", "toxicity", "urls", "neardup"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"tessera.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tessera.llm.{name}"), "ORACLE", {})
    return found
