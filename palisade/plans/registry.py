"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where SQL can say it, its oracle."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def joined(values: Column | str, sort: bool = False) -> Column:
    """An array as one text, '|' between entries."""
    values = F.col(values) if isinstance(values, str) else values
    if sort:
        values = F.array_sort(values)
    return F.coalesce(F.array_join(values, "|"), F.lit(""))


def big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def secs(value: Column | str) -> Column:
    """Whole epoch seconds, comparable across engines."""
    return F.floor(F.unix_micros(F.col(value) if isinstance(value, str) else value) / 1_000_000).cast("long")
