"""Merges, upserts, retention and other changes, each as a new state from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mailboxes import consumer
from .lifecycle import parasite

#: Relation types from the most to the least engaging.
RELATION_PRIORITY = ("client", "prospect", "investisseur", "partenaire", "presse_media", "conference", "fournisseur", "newsletter")
#: Ranks of stages that only rise.
STAGE_RANK = {"nouveau": 0, "qualifie": 1, "opportunite": 2, "client": 3}
CANDIDATE_RANK = {"nouveau": 0, "preselection": 1, "entretien": 2, "retenu": 3, "vivier": 3, "refuse": 3}
#: Allowed steps of a campaign.
CAMPAIGN_STEPS = {"start": (("draft", "scheduled"), "running"), "pause": (("running",), "paused"), "resume": (("paused",), "running"), "cancel": (("draft", "scheduled", "running", "paused"), "cancelled")}


class BlastRadius(RuntimeError):
    """A deletion that takes too large a share."""


def guard_share(total: int, doomed: int, share: float = 0.3, floor: int = 1000, attended: bool = True) -> None:
    """Refuse a deletion over a share of all rows, or unattended over a number of rows."""
    if total and doomed / total > share:
        raise BlastRadius(f"{doomed} of {total} rows are over {share:.0%}")
    if not attended and doomed > floor:
        raise BlastRadius(f"{doomed} rows are over {floor} without an operator")


def purge(df: DataFrame, doomed: Column, share: float = 0.3, attended: bool = True) -> DataFrame:
    """Rows that stay, if the guard lets the others go."""
    n = df.agg(F.count("*").alias("n"), F.count_if(doomed).alias("d")).first()
    guard_share(n["n"], n["d"], share, attended=attended)
    return df.where(~F.coalesce(doomed, F.lit(False)))


def is_empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def source_merge(state: DataFrame, batch: DataFrame, key: str, order: str, owned: list[str], backfill: list[str], today: str, archive: bool = True) -> DataFrame:
    """The merged state with ``outcome``: inserted, updated, unchanged, archived or kept; and ``revived``.

    Of equal keys the first row of the batch wins, and in the state the smallest id.  Owned
    columns follow the source (compared as text), backfilled ones fill what is empty, a row
    that comes back is revived, and rows that the batch lacks are archived unless it is a
    partial one.
    """
    if batch.isEmpty():
        raise ValueError("an empty batch would archive everything")
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    new = first.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_n_{c}") for c in (*owned, *backfill)])
    old = state.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy("id")) == 1)
    both = old.join(new, (old[key] == new["_key"]) & old["_first"], "full_outer")
    seen, known = F.col("_key").isNotNull(), F.col("_first").isNotNull()
    changes = {c: F.when(seen, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in owned}
    changes |= {c: F.when(seen & is_empty(F.col(c)), F.coalesce(F.when(~is_empty(F.col(f"_n_{c}")), F.col(f"_n_{c}")), F.col(c))).otherwise(F.col(c)) for c in backfill}
    differs = F.lit(False)
    for c, value in changes.items():
        differs = differs | ~F.col(c).cast("string").eqNullSafe(value.cast("string"))
    back = known & seen & F.col("deleted_on").isNotNull()
    gone = known & ~seen & F.col("_first") & F.col("deleted_on").isNull() & F.lit(archive)
    outcome = F.when(~known, "inserted").when(seen & (differs | back), "updated").when(seen, "unchanged").when(gone, "archived").otherwise("kept")
    deleted = F.when(gone, F.lit(today).cast("date")).when(~seen, F.col("deleted_on"))
    values = both.withColumns({"outcome": outcome, "revived": F.coalesce(back, F.lit(False)), "_deleted": deleted, "_k": F.coalesce(key, "_key")} | {f"_v_{c}": v for c, v in changes.items()})
    kept = [c for c in state.columns if c not in (*changes, key, "deleted_on")]
    return values.select(F.col("_k").alias(key), *kept, *[F.col(f"_v_{c}").alias(c) for c in changes], F.col("_deleted").alias("deleted_on"), "outcome", "revived")


def fill_collected(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Collected values fill empty columns only, never a declared one; origins say who filled what."""
    new = incoming.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = current.join(new, current[key] == new["_k"], "left")
    take = {c: is_empty(F.col(c)) & ~is_empty(F.col(f"_n_{c}")) & ~F.coalesce(F.try_element_at("field_origins", F.lit(c)) == "declared", F.lit(False)) for c in columns}
    filled = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in take.items()]))
    marks = F.map_from_arrays(filled, F.transform(filled, lambda _: F.lit("collected")))
    origins = F.map_zip_with(F.coalesce("field_origins", F.create_map().cast("map<string,string>")), marks, lambda _, a, b: F.coalesce(b, a))
    out = joined.withColumn("_origins", origins).withColumns({f"_v_{c}": F.when(t, F.col(f"_n_{c}")).otherwise(F.col(c)) for c, t in take.items()})
    return out.select(*[F.col(f"_v_{c}").alias(c) if c in columns else F.col("_origins").alias(c) if c == "field_origins" else F.col(c) for c in current.columns])


def write_declared(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Declared values replace what is there, and are marked as declared."""
    new = incoming.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = current.join(new, current[key] == new["_k"], "left")
    given = F.array_compact(F.array(*[F.when(~is_empty(F.col(f"_n_{c}")), F.lit(c)) for c in columns]))
    marks = F.map_from_arrays(given, F.transform(given, lambda _: F.lit("declared")))
    origins = F.map_zip_with(F.coalesce("field_origins", F.create_map().cast("map<string,string>")), marks, lambda _, a, b: F.coalesce(b, a))
    out = joined.withColumn("_origins", origins)
    return out.select(*[F.coalesce(F.when(~is_empty(F.col(f"_n_{c}")), F.col(f"_n_{c}")), F.col(c)).alias(c) if c in columns else F.col("_origins").alias(c) if c == "field_origins" else F.col(c) for c in current.columns])


def _rank(c: Column, ranks: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c)


def merge_relation(current: Column, incoming: Column) -> Column:
    """The more engaging of two relation types; one outside the list gives way."""
    ranks = {r: i for i, r in enumerate(RELATION_PRIORITY)}
    mine, theirs = _rank(current, ranks), _rank(incoming, ranks)
    return F.when(is_empty(current) | mine.isNull(), incoming).when(theirs.isNull(), current).when(theirs < mine, incoming).otherwise(current)


def merge_stage(current: Column, incoming: Column) -> Column:
    """Never back; perdu stays; dormant wakes."""
    zero = lambda c: F.coalesce(_rank(c, STAGE_RANK), F.lit(0))
    return F.when(is_empty(current), incoming).when(current == "perdu", "perdu").when(current == "dormant", F.when(incoming == "nouveau", "qualifie").otherwise(incoming)).when(zero(incoming) > zero(current), incoming).otherwise(current)


def merge_candidate_stage(current: Column, incoming: Column) -> Column:
    zero = lambda c: F.coalesce(_rank(c, CANDIDATE_RANK), F.lit(0))
    return F.when(is_empty(current) | (zero(incoming) >= zero(current)), incoming).otherwise(current)


def merge_legal_basis(current: Column, incoming: Column) -> Column:
    return F.when(is_empty(current) | (current == "legitimate_interest_b2b"), incoming).when(current.isin("contract", "legal_obligation"), current).when((current == "consent") & (incoming == "precontractual"), current).otherwise(incoming)


def fold_stages(events: DataFrame, key: str, at: str, event_id: str, stage: str) -> DataFrame:
    """Each subject's stage after all its events in order (``merge_stage`` on each; the steps don't commute).

    An empty or dormant stage takes whatever comes, so the first event of another stage
    decides, with the one just before it; from then on only the highest rank counts.  All
    of these are minima and maxima with map-side parts, so no task holds a subject's events.
    """
    order, what = F.struct(at, event_id, stage), F.col(stage)
    idle = is_empty(what) | (what == "dormant")
    rank = F.coalesce(_rank(what, STAGE_RANK), F.lit(0))
    whole = events.groupBy(key).agg(F.min(F.when(~idle, order)).alias("_first"), F.max(order).alias("_last"), F.max(rank).alias("_top"))
    new = whole.where(F.col("_first")[stage] == "nouveau").select(F.col(key).alias("_k"), F.col("_first").alias("_f"))
    before = events.where(idle).join(new, F.col(key).eqNullSafe(F.col("_k"))).where(order < F.col("_f")).groupBy("_k").agg(F.max(order)[stage].alias("_before"))
    first = F.when((F.col("_first")[stage] == "nouveau") & (F.col("_before") == "dormant"), "qualifie").otherwise(F.col("_first")[stage])
    highest = F.element_at(F.create_map(*[F.lit(x) for k, v in STAGE_RANK.items() for x in (v, k)]), F.col("_top"))
    after = F.when(F.col("_first").isNull(), F.col("_last")[stage]).when(first == "perdu", first).when(F.col("_top") > F.coalesce(_rank(first, STAGE_RANK), F.lit(0)), highest).otherwise(first)
    return whole.join(before, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, after.alias("stage"))


def ingest_once(known: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows to append: new keys only, the first of each."""
    first = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return first.join(known.select(key).distinct(), key, "left_anti")


def sync_tags(attached: DataFrame, desired: DataFrame) -> DataFrame:
    """(company_id, slug, action): what to add and what to remove; hand-made and src: tags are never removed."""
    add = desired.join(attached, ["company_id", "slug"], "left_anti").select("company_id", "slug", F.lit("add").alias("action"))
    ours = attached.where((F.col("assigned_by") == "auto") & ~F.col("slug").startswith("src:"))
    return add.unionByName(ours.join(desired, ["company_id", "slug"], "left_anti").select("company_id", "slug", F.lit("remove").alias("action")))


def set_stage(companies: DataFrame, stage: str) -> DataFrame:
    """Companies with their new stage and whether the step was refused as one back."""
    after = merge_stage(F.col("lifecycle_stage"), F.lit(stage))
    return companies.select("id", "lifecycle_stage", after.alias("new_stage"), (after != stage).alias("refused"))


def suppress(current: DataFrame, events: DataFrame, threshold: int = 3, days: int = 30) -> DataFrame:
    """Suppression list after events (scope, email_hash, reason, at): counts add up, the severest reason stays.

    Soft bounces count only where ``threshold`` of them come within ``days``: one is as near as that to
    the one ``threshold - 1`` before it.
    """
    severity = {"soft_bounce": 1, "manual": 2, "hard_bounce": 3, "complaint": 4}
    order = Window.partitionBy("scope", "email_hash").orderBy("at")
    soft = events.where("reason = 'soft_bounce'").withColumn("_b", F.lag("at", threshold - 1).over(order))
    near = soft.where(F.col("at").cast("timestamp") < F.col("_b").cast("timestamp") + F.expr(f"INTERVAL {days} DAYS")).select("scope", "email_hash").distinct().withColumn("_near", F.lit(True))
    counted = events.groupBy("scope", "email_hash").agg(F.count("*").alias("n"), F.max_by("reason", _rank(F.col("reason"), severity)).alias("worst"), F.min("at").alias("first"), F.max("at").alias("last"))
    counted = counted.join(near, ["scope", "email_hash"], "left")
    new = counted.where((F.col("worst") != "soft_bounce") | F.col("_near")).select("scope", "email_hash", F.col("worst").alias("reason"), F.col("n").alias("occurrences"), F.col("first").alias("first_seen"), F.col("last").alias("last_seen"))
    return current.unionByName(new).groupBy("scope", "email_hash").agg(F.max_by("reason", _rank(F.col("reason"), severity)).alias("reason"), F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def site_status(current: Column, found: Column, passes: Column) -> Column:
    """pending to found or not_found; a second miss is exhausted; a found site that fails is dead."""
    return F.when(found, "found").when(current == "found", "dead").when((current == "not_found") & (passes >= 2), "exhausted").when(current.isin("pending", "not_found"), "not_found").otherwise(current)


def clean_shared(rows: DataFrame, column: str, threshold: int) -> DataFrame:
    """Parasites, and addresses of consumer providers that more than ``threshold`` rows share, are emptied.

    Shared addresses of other domains are right (chains, press kits) and stay.  Deleted rows
    neither count nor decide, but lose such an address as well.  A row with ``phone`` and ``enrich_status`` that loses its
    address and has no phone is pending again; the address also leaves the array ``channel_emails`` where there is one.
    """
    live = rows.where(F.col(column).isNotNull() & (F.col("deleted_on").isNull() if "deleted_on" in rows.columns else F.lit(True)))
    counts = live.groupBy(F.lower(column).alias("_e")).agg(F.count("*").alias("_n"))
    bad = counts.where(parasite(F.col("_e")) | ((F.col("_n") > threshold) & consumer(F.col("_e")))).select("_e")
    joined = rows.join(bad, F.lower(rows[column]) == bad["_e"], "left")
    gone = F.col("_e").isNotNull()
    out = joined.withColumn(column, F.when(~gone, F.col(column)))
    if {"phone", "enrich_status"} <= set(rows.columns):
        out = out.withColumn("enrich_status", F.when(gone & F.col("phone").isNull(), "pending").otherwise(F.col("enrich_status")))
    out = out.drop("_e")
    if "channel_emails" in rows.columns:
        each = rows.select("id", F.explode("channel_emails").alias("_x")).join(bad, F.lower("_x") == F.col("_e"), "left_semi").groupBy("id").agg(F.collect_set(F.lower("_x")).alias("_gone"))  # a row's own list
        left = F.filter("channel_emails", lambda e: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<string>")), F.lower(e)))
        out = out.join(each, "id", "left").withColumn("channel_emails", left).drop("_gone")
    return out


def verify_chain(log: DataFrame, genesis: str = "0" * 64, shard: int = 100_000) -> DataFrame:
    """Rows of a hash-chained log that break it: (id, link_ok, hash_ok).

    The row before is found by ranges of ids and their borders, so the log is never one sort in one task.
    """
    spans = log.withColumn("_s", F.floor(F.col("id") / shard))
    last = spans.groupBy("_s").agg(F.max_by("current_hash", "id").alias("_last"))
    order = Window.orderBy("_s")  # one row for each range
    borders = last.select(F.col("_s").alias("_b"), F.lag("_last").over(order).alias("_border"))
    joined = spans.join(borders, F.col("_s") == F.col("_b"))
    before = F.coalesce(F.lag("current_hash").over(Window.partitionBy("_s").orderBy("id")), F.col("_border"), F.lit(genesis))
    checked = joined.withColumn("link_ok", F.col("prev_hash") == before).withColumn("hash_ok", F.col("current_hash") == F.sha2(F.concat("prev_hash", F.lit("|"), "payload_hash"), 256))
    return checked.where("not (link_ok and hash_ok)").select("id", "link_ok", "hash_ok")
