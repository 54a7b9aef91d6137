"""All queries over the test tables, by name, with the SQL that each should equal."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("text_queries", "retrieval_queries", "graph_queries", "gap_queries", "stat_queries")


def query(name: str, sql: str | None = None):
    """Register a query function (spark, sf_dir) under ``name``."""

    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    from importlib import import_module

    for m in _MODULES:
        import_module(f"lacuna.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
