"""Named queries of the engine, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "cond_agg_by_flag"


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


from brindle.plans import graph_queries, report_queries, rule_queries, search_queries, table_queries, text_queries  # noqa: E402,F401
