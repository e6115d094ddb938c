"""Queries of stored tables that are changed in part, of landed pages, networks and picks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import networks, picks, tables
from ..operators import rollups as ru
from ..sources import pages
from .feeds import scratch
from .registry import query
from .scalars import _NORM


@query("k05_upsert", "SELECT id, CASE WHEN id % 3 = 0 THEN quality_score + 1 ELSE quality_score END AS quality_score, email_generic FROM companies UNION ALL SELECT id + 10000000, quality_score, coalesce(phone, '') FROM companies WHERE id % 5 = 0", ("companies",))
def upsert(v):
    """Every third company gets a point and keeps its address where it has one; one in five comes as a new one."""
    name = f"upsert_{uuid.uuid4().hex}"
    tables.create_keyed(v.companies.select("id", "quality_score", "email_generic"), name, "id", scratch(v.spark), parts=8, buckets=4)
    known = v.companies.where("id % 3 = 0").select("id", (F.col("quality_score") + 1).alias("quality_score"), "email_generic")
    new = v.companies.where("id % 5 = 0").select((F.col("id") + 10_000_000).alias("id"), "quality_score", F.coalesce("phone", F.lit("")).alias("email_generic"))
    tables.upsert(v.spark, name, known.unionByName(new), "id", lambda c, was, comes: F.coalesce(comes, was), parts=8)
    return v.spark.table(name).drop(tables.PART)


@query("m20_clock_repair", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN ts + INTERVAL 1 HOUR ELSE ts END AS fixed FROM events")
def clock(v):
    """What the application wrote is UTC and becomes Paris time, in ranges of ids; the run is stopped after two ranges and goes on."""
    folder = scratch(v.spark)
    ours = F.col("event_type").isin("view", "click")
    fixed = lambda df: df.select("event_id", F.when(ours, F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Paris").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("fixed"))
    size = 1 + v.events.agg(F.max("event_id")).first()[0] // 4
    while tables.repair_ranges(v.events, "event_id", size, fixed, folder, most=2):
        pass
    return v.spark.read.parquet(f"{folder}/rows").select("event_id", "fixed")


_CHANGED = """SELECT workspace_id, CASE WHEN id % 7 = 0 THEN '38' || lpad((id % 50)::VARCHAR, 3, '0') ELSE postcode END AS postcode, naf, size_category, CASE WHEN id % 7 = 0 THEN 95 ELSE quality_score END AS quality_score, CASE WHEN id % 7 = 0 THEN enriched_on - 3 ELSE enriched_on END AS enriched_on FROM companies WHERE id % 11 <> 0
UNION ALL SELECT workspace_id, postcode, naf, size_category, 10, enriched_on + 1 FROM companies WHERE id % 13 = 0"""


@query("k10_incremental_matrix", f"SELECT workspace_id, postcode, naf, size_category, count(*) AS total, count(*) FILTER (quality_score >= 90) AS complete, count(*) FILTER (quality_score BETWEEN 50 AND 89) AS partial, max(enriched_on) AS last_enriched, substr(postcode, 1, 2) AS department FROM ({_CHANGED}) GROUP BY ALL", ("companies",))
def incremental(v):
    """Companies move, go and come; the matrix stored before is brought up to date."""
    columns = [*tables.CELL, "quality_score", "enriched_on"]
    moved, old = F.col("id") % 7 == 0, v.companies
    after = old.where(moved & (F.col("id") % 11 != 0)).withColumn("postcode", F.concat(F.lit("38"), F.lpad((F.col("id") % 50).cast("string"), 3, "0"))).withColumn("quality_score", F.lit(95)).withColumn("enriched_on", F.date_sub("enriched_on", 3))
    new = old.where("id % 13 = 0").withColumn("quality_score", F.lit(10)).withColumn("enriched_on", F.date_add("enriched_on", 1))
    changed = after.select(*columns).unionByName(new.select(*columns))
    now = old.where(~moved & (F.col("id") % 11 != 0)).select(*columns).unionByName(changed)
    folder = scratch(v.spark)
    ru.coverage_matrix(old).write.parquet(folder)
    return tables.coverage_after(v.spark.read.parquet(folder), old.where(moved | (F.col("id") % 11 == 0)).select(*columns), changed, now)


@query("p18_name_postings", f"SELECT id FROM companies WHERE contains({_NORM('denomination')}, 'cafe noel') OR contains({_NORM('denomination')}, '12') OR contains({_NORM('denomination')}, 'forge customer')", ("companies",))
def postings(v):
    folder = scratch(v.spark)
    tables.write_postings(v.companies, "id", "denomination", folder)
    return tables.search_postings(v.spark, folder, ["Café  Noël", "12", "Forge Customer"])


_OCTETS = "(event_id * 7919) % 256, (event_id * 104729) % 256, (user_id * 31) % 256, event_id % 256"


@query(
    "f45_networks",
    f"""WITH n AS (SELECT DISTINCT 8 + s_suppkey % 17 AS bits, ((s_suppkey * 37) % 256) * 16777216 + ((s_suppkey * 101) % 256) * 65536 + ((s_suppkey * 11) % 256) * 256 AS base FROM supplier),
a AS (SELECT event_id, ((event_id * 7919) % 256) * 16777216 + ((event_id * 104729) % 256) * 65536 + ((user_id * 31) % 256) * 256 + event_id % 256 AS x FROM events)
SELECT event_id, EXISTS (SELECT 1 FROM n WHERE a.x // CAST(pow(2, 32 - n.bits) AS BIGINT) = n.base // CAST(pow(2, 32 - n.bits) AS BIGINT)) AS denied FROM a""",
)
def denied(v):
    """The events' addresses against a network for each supplier."""
    whole = lambda *xs: F.concat_ws(".", *[F.expr(x).cast("string") for x in xs])
    nets = v.supplier.select(F.concat(whole("(s_suppkey * 37) % 256", "(s_suppkey * 101) % 256", "(s_suppkey * 11) % 256", "0"), F.lit("/"), (F.col("s_suppkey") % 17 + 8).cast("string")).alias("net"))
    return networks.in_networks(v.events.select("event_id", whole(*_OCTETS.split(", ")).alias("ip")), "ip", nets, "net").select("event_id", "denied")


@query("w06_weighted_pick", "WITH w AS (SELECT n_nationkey AS id, n_regionkey + 1 AS w FROM nation) SELECT id AS pick, true AS fair FROM w")
def pick(v):
    """Whether each nation is picked by customers as often as its weight says: within five deviations of the binomial."""
    chosen = picks.weighted_pick(v.customer, "c_custkey", v.nation.select("n_nationkey", (F.col("n_regionkey") + 1).alias("w")), "n_nationkey", "w", 7)
    shares = v.nation.select(F.col("n_nationkey").alias("pick"), (F.col("n_regionkey") + 1).alias("w"))
    sums = shares.agg(F.sum("w").alias("all_w")).crossJoin(v.customer.agg(F.count("*").alias("n")))  # one row each
    counted = shares.join(chosen.groupBy("pick").agg(F.count("*").alias("got")), "pick", "left").join(F.broadcast(sums))
    p = F.col("w") / F.col("all_w")
    return counted.select("pick", (F.abs(F.coalesce("got", F.lit(0)) - F.col("n") * p) <= 5 * F.sqrt(F.col("n") * p * (1 - p)) + 1).alias("fair"))


@query("s11_landed_pages", "SELECT id, naf, effectif_range FROM companies WHERE department_code IN ('38', '75') AND naf LIKE '62%' AND effectif_range IN ('11', '12', '21') UNION ALL SELECT id, naf, effectif_range FROM companies WHERE naf LIKE '4%' AND department_code = '31'", ("companies",))
def landed(v):
    folder = scratch(v.spark)
    rows = v.companies.select("id", "naf", "effectif_range", "department_code")
    pages.land_pages(rows, folder, "id", "department_code", "naf")
    some = pages.read_pages(v.spark, folder, rows.schema, ["38", "75"], "62", ("effectif_range", ["11", "12", "21"]))
    return some.unionByName(pages.read_pages(v.spark, folder, rows.schema, ["31"], "4")).select("id", "naf", "effectif_range")
