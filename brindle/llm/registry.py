"""Queries of this subpackage under the names the driver calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; oracle is DuckDB SQL for its rows, where there is one."""

    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


from brindle.llm import queries_audit, queries_chat, queries_dedup, queries_text  # noqa: E402,F401
