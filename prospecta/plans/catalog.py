"""All queries of the engine with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Views
from . import feeds, lifecycle, mailboxes, more, pending, people, reports, scalars, segments, stored, streams  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage_region(Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
