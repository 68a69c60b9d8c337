"""All registered queries: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function as ``name``, with its SQL if any."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def load(*modules: str) -> None:
    """Import the modules that register queries."""
    for name in modules:
        import_module(f"sondera.plans.{name}")


MODULES = ("signals", "relations", "geo", "inference", "records")
