"""Weighted picks by a seeded hash of the row: the same row gets the same pick at each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Equal pieces of the whole weight by which rows and choices are joined.
SLOTS = 4096


def weighted_pick(rows: DataFrame, key: str, choices: DataFrame, choice: str, weight: str, seed: int = 0) -> DataFrame:
    """``rows`` with ``pick``: of ``choices`` (whole weights; those without a positive one aren't picked) by the inverse of the cumulative weights.

    A row's hash names a number below the whole weight.  A choice covers the slots that its
    interval touches; rows meet the choices of their slot only, and one interval holds the number.
    No choices: null.
    """
    known = choices.where(F.col(weight) > 0).select(F.col(choice).alias("_pick"), F.col(weight).cast("long").alias("_w"))
    before = Window.orderBy(F.col("_pick")).rowsBetween(Window.unboundedPreceding, -1)  # over the choices, not the rows
    spans = known.withColumn("_from", F.coalesce(F.sum("_w").over(before), F.lit(0))).withColumn("_to", F.col("_from") + F.col("_w"))
    whole = known.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("s")).first()["s"]
    if not whole:
        return rows.withColumn("pick", F.lit(None).cast(choices.schema[choice].dataType))
    slot = lambda c: F.floor(c * F.lit(SLOTS) / F.lit(whole)).cast("int")
    held = spans.select("_pick", "_from", "_to", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to") - 1))).alias("_slot"))
    number = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(whole))
    asked = rows.withColumn("_r", number).withColumn("_slot", slot(number))
    return asked.join(held, "_slot").where("_r >= _from AND _r < _to").drop("_slot", "_r", "_from", "_to").withColumnRenamed("_pick", "pick")
