"""Registered queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("references", "patterns", "temporal", "graph", "texts", "entities", "views", "mentions", "cases")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").ORACLE
    return found
