"""The registered queries of the core, module by module."""

from __future__ import annotations

from collections.abc import Callable

from quern.queries import languages, lifecycle, measures, records, streams, timeseries

MODULES = (lifecycle, timeseries, records, measures, languages, streams)
FLAGSHIP = "ts_aggregate_mean"


def all_queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
