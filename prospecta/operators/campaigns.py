"""Campaigns under commands, with what follows for their runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import CAMPAIGN_STEPS

#: The runs that a command ends, and the reason they get.
CASCADES = {"pause": (("pending",), "Pause campagne"), "cancel": (("pending", "running"), "Campagne annulée")}


def command(campaigns: DataFrame, runs: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Campaigns, runs and (campaign_id, action, outcome) after commands (campaign_id, action, at).

    Campaigns have id, status, started_at, finished_at, paused_at, paused_reason; runs have campaign_id, status, finished_at, error.
    Of several commands to one campaign the first by (at, action) is taken and the others are ``left`` for the
    next batch, since they depend on it.  Outcome: done, refused (not from this status), unknown
    (campaign or action) or left.  Deletion of a campaign isn't a command.
    """
    first = commands.groupBy("campaign_id").agg(F.min(F.struct("at", "action")).alias("_c")).select("campaign_id", "_c.at", "_c.action")
    steps = [(a, s, to) for a, (allowed, to) in CAMPAIGN_STEPS.items() for s in allowed]
    # The table of steps is fixed, so it is an expression rather than a join.
    after = F.coalesce(*[F.when((F.col("_a") == a) & (F.col("status") == s), to) for a, s, to in steps])
    taken = campaigns.join(first.select(F.col("campaign_id").alias("_id"), F.col("at").alias("_at"), F.col("action").alias("_a")), F.col("id") == F.col("_id"), "left").withColumn("_to", after)
    done, act = F.col("_to").isNotNull(), F.col("_a")
    new = {
        "status": F.coalesce("_to", "status"),
        "started_at": F.when(done & (act == "start"), F.coalesce("started_at", "_at")).otherwise(F.col("started_at")),
        "finished_at": F.when(done & (act == "cancel"), F.col("_at")).otherwise(F.col("finished_at")),
        "paused_at": F.when(done & (act == "pause"), F.col("_at")).when(~(done & act.isin("start", "resume")) | act.isNull(), F.col("paused_at")),
        "paused_reason": F.when(done & (act == "pause"), F.lit("manual")).when(~(done & act.isin("start", "resume")) | act.isNull(), F.col("paused_reason")),
    }
    moved = taken.select(*[new[c].alias(c) if c in new else F.col(c) for c in campaigns.columns])
    ended = taken.where(done & act.isin(*CASCADES)).select(F.col("id").alias("_id"), "_at", "_a")
    hit = F.coalesce(*[F.when((F.col("_a") == a) & F.col("status").isin(*of), F.lit(why)) for a, (of, why) in CASCADES.items()])
    joined = runs.join(ended, runs["campaign_id"] == ended["_id"], "left").withColumn("_why", hit)
    out = {"status": F.when(F.col("_why").isNotNull(), "cancelled").otherwise(F.col("status")), "finished_at": F.when(F.col("_why").isNotNull(), F.col("_at")).otherwise(F.col("finished_at")), "error": F.coalesce("_why", "error")}
    stopped = joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in runs.columns])
    known = taken.where(F.col("_id").isNotNull()).select(F.col("_id"), F.col("_at"), F.col("_a"), done.alias("_done"))
    told = commands.join(known, F.col("campaign_id") == F.col("_id"), "left")
    mine = (F.col("at") == F.col("_at")) & (F.col("action") == F.col("_a"))
    outcome = F.when(F.col("_id").isNull() | ~F.col("action").isin(*CAMPAIGN_STEPS), "unknown").when(~mine, "left").when(F.col("_done"), "done").otherwise("refused")
    return moved, stopped, told.select("campaign_id", "action", "at", outcome.alias("outcome"))
