"""Operators for preparing language-model training data. Nothing outside this package imports it."""

from __future__ import annotations


def queries() -> dict:
    from stylomill.llm import registry

    return registry.queries()


def oracle_sql() -> dict:
    from stylomill.llm import registry

    return registry.oracle_sql()
