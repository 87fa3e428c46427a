"""The registry of queries: name, DataFrame plan, and SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .proxy import Graph, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a plan over Graph under a name, with its SQL if there is any."""

    def register(plan: Callable[[Graph], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Graph(spark, sf_dir))

        run.__doc__ = plan.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = with_views(sql)
        return plan

    return register
