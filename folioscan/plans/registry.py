"""Registry of queries: each inventory row has a Spark callable and, where SQL can say it, a DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, with_views


@dataclass(frozen=True)
class Query:
    key: str
    rows: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


CATALOG: dict[str, Query] = {}


def query(rows: str, key: str, oracle: str | None = None):
    """Register a query under `key`, covering the inventory rows named in `rows`."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if key in CATALOG:
            raise ValueError(f"duplicate query {key}")
        CATALOG[key] = Query(key, tuple(rows.split()), fn, with_views(oracle) if oracle else None)
        return fn

    return wrap
