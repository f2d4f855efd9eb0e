"""Queries by name and, where SQL can express them, the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Tables that the query running in a thread has made so far; absent outside of queries.
_RUN = threading.local()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; what ``once`` marks is made once in it."""

    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            before, _RUN.made = getattr(_RUN, "made", None), {}
            try:
                return f(spark, sf_dir)
            finally:
                _RUN.made = before

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def once(f: Query) -> Query:
    """A table of fixtures that one query makes once, however often it is asked for."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = getattr(_RUN, "made", None)
        if made is None:
            return f(spark, sf_dir)
        key = (f.__module__, f.__name__, sf_dir)
        if key not in made:
            made[key] = f(spark, sf_dir)
        return made[key]

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
