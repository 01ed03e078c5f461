"""The query catalogue: one entry per operator, each with its DuckDB counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from linkloom.plans.views import Tables, with_views

Build = Callable[[Tables], DataFrame]

_BUILDS: dict[str, Build] = {}
_ORACLES: dict[str, str] = {}

GROUPS = (
    "imports", "fetching", "statuses", "categorising", "taxonomies", "statistics",
    "browsing", "comparing", "training", "cleaning", "streams",
)


def add(name: str, build: Build, views: str = "", sql: str | None = None) -> None:
    """Register a query; ``views`` lists what the oracle text reads."""
    if name in _BUILDS:
        raise ValueError(f"duplicate query {name}")
    _BUILDS[name] = build
    if sql is not None:
        _ORACLES[name] = with_views(views, sql)


def _load() -> None:
    for group in GROUPS:
        import_module(f"linkloom.plans.entries.{group}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, b=build: b(Tables(spark, sf_dir))) for name, build in _BUILDS.items()}


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
