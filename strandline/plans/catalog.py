"""The register of queries: each operator applied to tables derived from the star schema, with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .carriers import Tables, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a function of Tables under a name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            head = with_sql(*uses) if uses else ""
            text = sql.strip()
            if text.upper().startswith("WITH RECURSIVE "):  # the word stands for all of a WITH clause
                head, text = head.replace("WITH", "WITH RECURSIVE", 1), "WITH " + text[15:]
            SQL[name] = f"{head}, {text[5:]}" if head and text[:5].upper() == "WITH " else f"{head} {text}"
        return f

    return add
