"""Registry of named queries.  Each entry is (spark, folder) -> DataFrame plus, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``name``; ``oracle`` is the equivalent DuckDB SQL over the same tables."""

    def keep(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return keep


def sql_list(values) -> str:
    """('a', 'b') for an IN list, or the inside of a DuckDB list literal."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
