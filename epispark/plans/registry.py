"""Registry of runnable queries: a Spark plan, the inventory ids it covers, an oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None = None):
    """Register ``build(spark, sf_dir)``; ``ids`` is a space-separated list of inventory ids."""

    def add(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(ids.split()), build, oracle)
        return build

    return add


def r(col: Column, n: int = 6) -> Column:
    """Rounded double without negative zero, the form in which results are compared."""
    return F.round(col, n) + F.lit(0.0)


def R(sql: str, n: int = 6) -> str:
    return f"(round({sql}, {n}) + 0.0)"
