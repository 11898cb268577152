"""The named queries: a function over the bound tables, its SQL, and the inventory rows it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..bindings import SQL, Tables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    rows: tuple[int, ...]


QUERIES: dict[str, Query] = {}


def query(sql: str | None, *rows: int):
    """Register a query; its SQL continues the common table expressions of the bindings."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        text = None if sql is None else f"{SQL.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}"
        QUERIES[f.__name__] = Query(f.__name__, f, text, rows)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import analysis, core, modules, more, reviews, states  # noqa: F401

    return {n: (lambda spark, sf_dir, q=q: q.run(Tables(spark, sf_dir))) for n, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {n: q.sql for n, q in QUERIES.items() if q.sql}
