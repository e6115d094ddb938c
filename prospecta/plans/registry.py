"""Where queries register themselves with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Views, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), more: str = "") -> Callable:
    """Register a function of Views; ``sql`` runs after CTEs of the views it names, and of ``more``."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            head = ctes(*views) if views else ""
            if more:
                head = f"{head}, {more}" if head else f"WITH {more}"
            own = f", {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f" {sql}"  # CTEs of its own go on with those
            SQL[name] = f"{head}{own}" if head else sql
        return f

    return register
