"""Registered queries with, where SQL can say it, the statement that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .context import Archive, flat
from .oracle_parts import with_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, parts: list[str] | None = None, sql: str | None = None):
    """Register ``build(archive)`` under a name; ``sql`` is its check over the named parts."""
    def add(build: Callable[[Archive], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return flat(build(Archive(spark, folder)))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_parts(parts or [], sql)
        return build
    return add
