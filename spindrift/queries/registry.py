"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a (spark, sf_dir) -> DataFrame function under its name, and the SQL that must equal it."""

    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add
