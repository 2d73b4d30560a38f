"""The catalogue: each query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "threshold_islands"

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under a name, with the SQL for its rows."""

    def put(fn: Callable) -> Callable:
        _queries[name] = fn
        if sql:
            _sql[name] = sql
        return fn

    return put


def _load() -> None:
    from momentis.plans import details, detecting, editing, imaging, library, merging, moments, more, novelty, relational, rollups, selection, sequential, sessions, streams, texts  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
