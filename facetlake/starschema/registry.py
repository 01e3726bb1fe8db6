"""Registry of named queries over the star schema, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from facetlake.session import tune
from facetlake.starschema.duckviews import with_views
from facetlake.starschema.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[Views], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Views(tune(spark, expanding=True), sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query. ``views`` names the derived SQL views its counterpart reads."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, ids, fn, with_views(views, sql) if sql else None)
        return fn

    return register
