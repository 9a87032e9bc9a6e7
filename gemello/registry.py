"""Queries of the comparison engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "numstat_by_lang"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if there is one."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


from gemello.queries import carried, diffs, folds, layout, metadata, streams, text, trees, views  # noqa: E402, F401  register their queries
