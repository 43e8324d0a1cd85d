"""Every query by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

MODULES = ("graph", "build", "search", "community", "merging", "text", "resolve", "feedback", "output", "streams", "scan", "links", "code", "display", "page", "upkeep", "scope", "nesting", "store", "reports", "binary")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame, with DuckDB SQL for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        import_module(f"weftline.plans.{m}_queries")
