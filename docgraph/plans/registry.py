"""All queries of the library and their SQL, by name."""

from __future__ import annotations

import importlib

FAMILIES: tuple[str, ...] = ("surface", "linking", "semantic", "engine", "lookups", "documents")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in FAMILIES:
        found.update(getattr(importlib.import_module(f"docgraph.plans.{name}"), attribute))
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
