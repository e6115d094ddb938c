"""Counts, censuses and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_matrix(companies: DataFrame) -> DataFrame:
    """One cell for each workspace, postcode, activity and size."""
    score = F.col("quality_score")
    return companies.groupBy("workspace_id", "postcode", "naf", "size_category").agg(
        F.count("*").alias("total"), F.count_if(score >= 90).alias("complete"), F.count_if(score.between(50, 89)).alias("partial"), F.max("enriched_on").alias("last_enriched"), F.min(F.substring("postcode", 1, 2)).alias("department")
    )


def coverage_by(cells: DataFrame, *keys: str | Column) -> DataFrame:
    """Cells summed up to wider places."""
    return cells.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("complete").alias("complete"), F.sum("partial").alias("partial"), F.max("last_enriched").alias("last_enriched"))


def closed_counts(df: DataFrame, column: str, vocabulary: tuple[str, ...]) -> DataFrame:
    """Counts for every word of a closed vocabulary, zeros included."""
    words = df.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{column} string")
    counts = df.where(F.col(column).isin(*vocabulary)).groupBy(column).agg(F.count("*").alias("n"))
    return words.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def hub_counters(companies: DataFrame, types: tuple[str, ...], stages: tuple[str, ...]) -> DataFrame:
    """(facet, value, n): totals by type and by stage over the closed vocabularies, and the whole, in one scan."""
    cells = companies.groupBy("relation_type", "lifecycle_stage").agg(F.count("*").alias("n"))
    wanted = companies.sparkSession.createDataFrame([("type", t) for t in types] + [("stage", s) for s in stages] + [("all", "all")], "facet string, value string")
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), c.alias("value")) for f, c in (("type", F.col("relation_type")), ("stage", F.col("lifecycle_stage")), ("all", F.lit("all")))])).alias("x"), "n")
    sums = long.groupBy("x.facet", "x.value").agg(F.sum("n").alias("n"))
    return wanted.join(sums, ["facet", "value"], "left").select("facet", "value", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_census(contacts: DataFrame) -> DataFrame:
    """By workspace: rows, with address, distinct addresses, groups of two and more, their rows, the surplus."""
    groups = contacts.groupBy("workspace_id", F.lower("email").alias("_e")).agg(F.count("*").alias("_n"))
    known, twice = F.col("_e").isNotNull(), F.col("_e").isNotNull() & (F.col("_n") > 1)
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))
    out = groups.groupBy("workspace_id").agg(F.sum("_n").alias("n_rows"), total(known).alias("with_email"), F.count_if(known).alias("distinct_emails"), F.count_if(twice).alias("n_groups"), total(twice).alias("rows_in_groups"))
    return out.withColumn("surplus", F.col("rows_in_groups") - F.col("n_groups"))


def top_duplicates(contacts: DataFrame, k: int = 10, ids: int = 5) -> DataFrame:
    """The largest groups with their first ids."""
    key = ["workspace_id", "email"]
    rows = contacts.where(F.col("email").isNotNull()).select("workspace_id", F.lower("email").alias("email"), "id", F.pmod(F.hash("id"), F.lit(256)).alias("salt"))
    largest = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *key).limit(k)
    # ids of the k groups alone, the first ones of each salt and then of all
    first = lambda c: F.slice(F.sort_array(c), 1, ids)
    some = rows.join(largest, key).groupBy(*key, "n", "salt").agg(first(F.collect_list("id")).alias("some"))
    groups = some.groupBy(*key, "n").agg(first(F.flatten(F.collect_list("some"))).alias("first_ids"))
    return groups.orderBy(F.desc("n"), "workspace_id", "email").limit(k)


def legal_basis_census(df: DataFrame) -> DataFrame:
    """By source: rows, with and without a legal basis, and the percentage."""
    source = F.coalesce(F.when(F.trim("discovery_source") != "", F.trim("discovery_source")), F.lit("(none)"))
    has = F.coalesce(F.trim("legal_basis") != "", F.lit(False))
    out = df.groupBy("workspace_id", source.alias("origin")).agg(F.count("*").alias("total"), F.count_if(has).alias("with_basis"), F.count_if(~has).alias("without_basis"))
    return out.withColumn("percent", F.round(F.col("with_basis") * 100.0 / F.col("total"), 2))


def run_stats(runs: DataFrame, *keys: str) -> DataFrame:
    """Status counts, clamped time and distinct companies of runs."""
    s = F.col("status")
    return runs.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(s == "success").alias("success"), F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("queued", "running")).alias("open"),
        F.sum(F.greatest(F.lit(0), "latency_ms")).alias("busy_ms"), F.count_distinct(F.when(s == "success", F.col("company_id"))).alias("companies"),
    )


def failure_anomalies(runs: DataFrame, since: str, least: int = 20, rate: float = 0.15) -> DataFrame:
    """Sources whose failure rate is over the threshold since a time."""
    out = runs.where(F.col("started_at") >= F.lit(since).cast("timestamp_ntz")).groupBy("workspace_id", "source").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))
    share = F.col("failed") / F.nullif("total", F.lit(0))
    return out.where((F.col("total") >= least) & (share > rate)).withColumn("failure_rate", F.round(share, 6))


def usage_by(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("tokens_input").alias("tokens_in"), F.sum("tokens_output").alias("tokens_out"), F.sum("cost_micros").alias("cost_micros"), F.count_if("cache_hit").alias("cache_hits"))


def over_cap(usage: DataFrame, caps: DataFrame, share: float) -> DataFrame:
    """Days on which a workspace spent more than a share of its cap; cap 0 is no cap."""
    days = usage.groupBy("workspace_id", F.to_date("created_at").alias("day")).agg(F.sum("cost_micros").alias("cost_micros"))
    return days.join(caps, "workspace_id").where((F.col("cap_micros") > 0) & (F.col("cost_micros") > F.col("cap_micros") * share))


def best_confidence(contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """A company's best tier (A before B before C) over its contacts and its own address."""
    from ..functions.contact import email_confidence

    sites = companies.select(F.col("id").alias("_cid"), F.col("website").alias("_site"))
    tiers = contacts.where(F.col("email").isNotNull()).join(sites, contacts["company_id"] == sites["_cid"]).select("_cid", email_confidence(F.col("email"), F.col("_site")).alias("_tier"))
    people = tiers.groupBy("_cid").agg(F.min("_tier").alias("_people"))
    own = email_confidence(F.when(F.col("email_generic") != "", F.col("email_generic")), F.col("website"))
    return companies.join(people, companies["id"] == people["_cid"], "left").select("id", F.least("_people", own).alias("best"))


def divergence(df: DataFrame, stored: str, computed: Column) -> DataFrame:
    """By workspace: rows whose stored value isn't the computed one, and in which direction."""
    s = F.col(stored)
    return df.groupBy("workspace_id").agg(F.count("*").alias("total"), F.count_if(~s.eqNullSafe(computed)).alias("different"), F.count_if(s < computed).alias("under"), F.count_if(s > computed).alias("over"))
