from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def register(run: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def rnd(expression: str, digits: int) -> str:
    """SQL that rounds the binary value correctly (``round`` works on the scaled value)."""
    return f"CAST(format('{{:.{digits}f}}', CAST({expression} AS DOUBLE)) AS DOUBLE)"
