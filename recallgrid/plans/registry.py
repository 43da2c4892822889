"""Registry of queries and of the DuckDB SQL that checks them.

SQL is put together from named common table expressions; a query names the last select
and gets the expressions it needs, in the order in which they were defined.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallgrid.functions.lineage import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CTES: dict[str, str] = {}
_SHARED: dict = {}


def kept(f):
    """A table that several parts of one query use and that its operator has written: made once for each query that is built."""

    @functools.wraps(f)
    def once(spark, d, *args):
        key = (f.__module__, f.__name__, d, *args)
        if key not in _SHARED:
            _SHARED[key] = f(spark, d, *args)
        return _SHARED[key]

    return once


def shared(f):
    """As ``kept``, and written."""

    @kept
    @functools.wraps(f)
    def made(spark, d, *args):
        out = f(spark, d, *args)
        return tuple(settle(x) for x in out) if isinstance(out, tuple) else settle(out)

    return made


def query(name: str, sql: str | None = None):
    """Registers a query function, with a final select over the named expressions."""

    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _SHARED.clear()
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_ctes(sql)
        return f

    return add


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    needed: set[str] = set()
    waiting = [sql]
    while waiting:
        text = waiting.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                waiting.append(CTES[name])
    body = ", ".join(f"{n} AS ({s})" for n, s in CTES.items() if n in needed)
    return (f"WITH RECURSIVE {body} " if body else "") + sql


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
