"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from quern.llm import keyed_queries, text_queries

MODULES = (keyed_queries, text_queries)


def all_queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
