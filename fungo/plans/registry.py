"""Registered queries: name -> Spark job, and independent SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Registers a job (spark, sf_dir) -> DataFrame under its function's name."""

    def put(job):
        _QUERIES[job.__name__] = job
        if sql is not None:
            _SQL[job.__name__] = sql
        return job

    return put


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


def _load() -> None:
    for name in ("core", "sources", "scalars", "profiles", "ranks", "scale"):
        import_module(f"fungo.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
