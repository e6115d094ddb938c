"""Decisions on records that no company was found for: attach to a company, or dismiss with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arbitrate(activities: DataFrame, companies: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(activity_id, decision_no, action, company_id, reason)`` with ``outcome``, as if taken one after the other.

    ``invalid``: no company, or a reason that isn't 3 to 500 characters long.  ``not_found``: no such activity, or no live
    company of that id in its workspace.  ``conflict``: the activity has a company, from before or by an earlier decision,
    or wasn't pending.  Else ``attached`` or ``dismissed``.  A dismissed activity can still be attached.
    """
    live = companies.where("deleted_on IS NULL").select(F.col("id").alias("company_id"), "workspace_id", F.lit(True).alias("_live"))
    known = activities.select("activity_id", "workspace_id", "subject_id", "pending", F.lit(True).alias("_known"))
    rows = decisions.join(known, "activity_id", "left").join(live, ["company_id", "workspace_id"], "left")
    attach = F.col("action") == "attach"
    size = F.length(F.trim(F.coalesce("reason", F.lit(""))))
    valid = F.when(attach, F.coalesce(F.col("company_id") >= 1, F.lit(False))).otherwise(size.between(3, 500))
    fits = attach & valid & F.col("subject_id").isNull() & F.col("pending") & F.col("_live")
    first = rows.where(fits).groupBy("activity_id").agg(F.min("decision_no").alias("_first"))
    taken = F.col("subject_id").isNotNull() | F.coalesce(F.col("decision_no") > F.col("_first"), F.lit(False))
    outcome = (
        F.when(~valid, "invalid")
        .when(F.col("_known").isNull(), "not_found")
        .when(taken, "conflict")
        .when(~attach, "dismissed")
        .when(~F.coalesce("pending", F.lit(False)), "conflict")
        .when(F.col("_live").isNull(), "not_found")
        .otherwise("attached")
    )
    return rows.join(first, "activity_id", "left").select(*decisions.columns, outcome.alias("outcome"))


def settled(activities: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``activities`` with the company attached to and the last ``dismissed_reason``."""
    done = outcomes.groupBy("activity_id").agg(
        F.max(F.when(F.col("outcome") == "attached", F.col("company_id"))).alias("_company"),
        F.max_by(F.trim("reason"), F.when(F.col("outcome") == "dismissed", F.col("decision_no"))).alias("dismissed_reason"),
    )
    return activities.join(done, "activity_id", "left").withColumn("subject_id", F.coalesce("subject_id", "_company")).drop("_company")
