"""Named queries of the core library and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

MODULES = ("eda", "pairs", "segment", "evaluation", "attack", "lines")
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"stylomill.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
