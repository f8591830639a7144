"""Registry of runnable queries: name -> callable(spark, sf_dir), and the DuckDB SQL that must agree with it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.standins import Tables, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register f(tables) under name, with its oracle where SQL can express it."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    for m in ("relational", "aggregates", "windows", "scalars", "statistics", "search", "graph", "balance", "evidence", "workflow", "readers"):
        importlib.import_module(f"quillon.plans.{m}")
