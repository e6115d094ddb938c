"""Landed pages of a registry interface: filters choose the pages that are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the landed pages: what the interface itself filters by.
KEYS = ("page_department", "page_activity")
PAGE = 1000


def land_pages(rows: DataFrame, folder: str, order: str, department: str, activity: str, size: int = PAGE) -> None:
    """Write ``rows`` as JSON pages of at most ``size`` rows, in folders by department and division of activity."""
    none = lambda c: F.coalesce(c, F.lit("none"))
    placed = rows.withColumn(KEYS[0], none(F.col(department))).withColumn(KEYS[1], none(F.substring(activity, 1, 2)))
    placed.repartition(*KEYS).sortWithinPartitions(*KEYS, order).write.partitionBy(*KEYS).option("maxRecordsPerFile", size).option("ignoreNullFields", False).json(folder)


def read_pages(spark: SparkSession, folder: str, schema, departments: list[str] | None = None, activity: str | None = None, staff: tuple[str, list[str]] | None = None) -> DataFrame:
    """Rows of the landed pages by department, prefix of activity and staff codes (column, codes); folders that can't have any aren't listed or read.

    An activity of one character chooses folders by prefix, a longer one its division's folder and then rows.
    """
    pages = spark.read.schema(f"{schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, {KEYS[0]} string, {KEYS[1]} string").json(folder)
    tests: list[Column] = []
    if departments is not None:
        tests.append(F.col(KEYS[0]).isin(departments))
    if activity:
        tests.append(F.col(KEYS[1]).startswith(activity[:2]) if len(activity) < 2 else F.col(KEYS[1]) == activity[:2])
        tests.append(F.col("naf").startswith(activity))
    if staff is not None:
        tests.append(F.col(staff[0]).isin(staff[1]))
    for t in tests:
        pages = pages.where(t)
    return pages.drop(*KEYS)
