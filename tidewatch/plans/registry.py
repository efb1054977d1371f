"""Named queries over the analytical tables, each with the ANSI SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# The explicit "now" of every time-dependent query; the event table ends the day before.
AS_OF = "2024-01-31 00:00:00"


def query(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register
