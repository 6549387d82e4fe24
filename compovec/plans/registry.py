"""The catalogue of runnable queries, each with its survey ids and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)`` under ``name`` for the survey ids in ``ids``."""
    def wrap(fn):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Query(name, tuple(ids.split()), fn, sql)
        return fn
    return wrap
