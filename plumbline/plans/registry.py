"""Named queries over the sample star schema, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import star
from plumbline.sources.environment import Env


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Env], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function ``env -> DataFrame`` under its own or the given name."""

    def add(fn: Callable[[Env], DataFrame]) -> Callable[[Env], DataFrame]:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} is defined twice")
        QUERIES[key] = Query(key, fn, sql)
        return fn

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, q=q: q.run(star.environment(spark, sf_dir))) for k, q in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q.sql for k, q in QUERIES.items() if q.sql is not None}
