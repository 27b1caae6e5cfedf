"""All queries of the environmental engine, with the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

FLAGSHIP = "station_hourly"
MODULES = ("cleaning", "grids", "inference", "knowledge", "streams", "surfaces", "reports", "remote", "solvers", "fits")
_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) query under ``name`` with its SQL."""

    def add(f):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _oracles[name] = sql
        return f

    return add


def _load() -> None:
    for module in MODULES:
        import_module(f"tidewatch.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
