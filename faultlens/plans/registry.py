"""Catalog of named queries. Each entry is a Spark query and, where SQL can say it, its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """Put in front the named sub-queries that the text uses, each after those it uses itself."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in ordered and body != text and re.search(rf"\b{name}\b", text):
                visit(body)
                ordered.append(name)

    visit(sql)
    return f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in ordered)} {sql}" if ordered else sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read as it is; how it is cut is a matter of the session's scan settings."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(expression: str) -> str:
    """Rounded to six places without a negative zero; the same text in both engines."""
    return f"round({expression}, 6) + 0.0"
