"""Queries of rollups, censuses and changes of state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as k
from ..operators import merge as m
from ..operators import rollups as ru
from ..sources.views import AS_OF, COMPANY_TAG
from .registry import query
from .scalars import _DOMAIN, _HOST, _PUBLIC, _ROOT, SCORE_SQL, scored
from .streams import FOLD_SQL

TYPES = ("prospect", "client", "presse_media", "partenaire", "investisseur", "conference", "newsletter", "fournisseur")
STAGES = ("nouveau", "qualifie", "opportunite", "client", "dormant", "perdu")
_CELLS = "cells AS (SELECT workspace_id, postcode, naf, size_category, count(*) AS total, count(*) FILTER (quality_score >= 90) AS complete, count(*) FILTER (quality_score BETWEEN 50 AND 89) AS partial, max(enriched_on) AS last_enriched, substr(postcode, 1, 2) AS department FROM companies GROUP BY ALL)"
_SUMS = "CAST(sum(total) AS BIGINT) AS total, CAST(sum(complete) AS BIGINT) AS complete, CAST(sum(partial) AS BIGINT) AS partial, max(last_enriched) AS last_enriched"
_REGION = " ".join(f"WHEN department IN ({', '.join(repr(x) for x in keys.split())}) THEN '{r}'" for r, keys in k.REGIONS.items())


@query("a01_coverage_matrix", "SELECT * FROM cells", ("companies",), _CELLS)
def matrix(v):
    return ru.coverage_matrix(v.companies)


@query("a02_coverage_region", f"SELECT CASE {_REGION} END AS region, {_SUMS} FROM cells GROUP BY 1", ("companies",), _CELLS)
def coverage_region(v):
    return ru.coverage_by(ru.coverage_matrix(v.companies).withColumn("region", k.region(F.col("department"))), "region")


@query("a02_coverage_department", f"SELECT department, {_SUMS} FROM cells GROUP BY department", ("companies",), _CELLS)
def coverage_department(v):
    return ru.coverage_by(ru.coverage_matrix(v.companies), "department")


@query("a02_coverage_city", f"SELECT c.city, d.* FROM (SELECT DISTINCT city, substr(postcode, 1, 2) AS department FROM companies WHERE city IS NOT NULL AND postcode IS NOT NULL) c JOIN (SELECT department, {_SUMS} FROM cells GROUP BY department) d ON c.department = d.department ORDER BY total DESC, city, d.department LIMIT 500", ("companies",), _CELLS)
def coverage_city(v):
    """Every city of a department gets the department's total, as the reference does."""
    cities = v.companies.where(F.col("city").isNotNull() & F.col("postcode").isNotNull()).select("city", F.substring("postcode", 1, 2).alias("department")).distinct()
    return cities.join(coverage_department(v), "department").orderBy(F.desc("total"), "city", "department").limit(500)


@query("a03_hub_counters", f"""SELECT w.facet, w.value, coalesce(n, 0) AS n FROM (SELECT 'type' AS facet, unnest([{', '.join(repr(t) for t in TYPES)}]) AS value UNION ALL SELECT 'stage', unnest([{', '.join(repr(s) for s in STAGES)}]) UNION ALL SELECT 'all', 'all') w
LEFT JOIN (SELECT 'type' AS facet, relation_type AS value, count(*) AS n FROM companies GROUP BY ALL UNION ALL SELECT 'stage', lifecycle_stage, count(*) FROM companies GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*) FROM companies) c ON w.facet = c.facet AND w.value = c.value""", ("companies",))
def hub(v):
    return ru.hub_counters(v.companies, TYPES, STAGES)


@query("a04_stage_counters", f"SELECT w.lifecycle_stage, coalesce(n, 0) AS n FROM (SELECT unnest([{', '.join(repr(s) for s in STAGES)}]) AS lifecycle_stage) w LEFT JOIN (SELECT lifecycle_stage, count(*) AS n FROM companies GROUP BY ALL) c ON w.lifecycle_stage = c.lifecycle_stage", ("companies",))
def stages(v):
    return ru.closed_counts(v.companies, "lifecycle_stage", STAGES)


@query("a05_dashboard", "SELECT workspace_id, count(*) AS companies, count(*) FILTER (email_generic IS NOT NULL) AS with_email, count(*) FILTER (enriched_on IS NOT NULL) AS enriched, count(*) FILTER (quality_score >= 90) AS complete, count(*) FILTER (quality_score BETWEEN 50 AND 89) AS partielle, count(*) FILTER (quality_score < 50) AS basique FROM companies GROUP BY ALL", ("companies",))
def dashboard(v):
    s = F.col("quality_score")
    return v.companies.groupBy("workspace_id").agg(F.count("*").alias("companies"), F.count_if(F.col("email_generic").isNotNull()).alias("with_email"), F.count_if(F.col("enriched_on").isNotNull()).alias("enriched"), F.count_if(s >= 90).alias("complete"), F.count_if(s.between(50, 89)).alias("partielle"), F.count_if(s < 50).alias("basique"))


_USE = "count(*) AS calls, CAST(sum(tokens_input) AS BIGINT) AS tokens_in, CAST(sum(tokens_output) AS BIGINT) AS tokens_out, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, count(*) FILTER (cache_hit) AS cache_hits"


@query("a06_usage_by_case", f"SELECT workspace_id, use_case_slug, provider, {_USE} FROM llm_usage GROUP BY ALL", ("llm_usage",))
def usage_case(v):
    return ru.usage_by(v.llm_usage, "workspace_id", "use_case_slug", "provider")


@query("a07_monthly_spend", "SELECT workspace_id, strftime(created_at, '%Y-%m') AS month, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, sum(cost_micros) > 9000000000 AS over_cap FROM llm_usage GROUP BY ALL", ("llm_usage",))
def monthly(v):
    return v.llm_usage.groupBy("workspace_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.sum("cost_micros").alias("cost_micros")).withColumn("over_cap", F.col("cost_micros") > 9_000_000_000)


@query("a15_daily_over_cap", "SELECT workspace_id, CAST(created_at AS DATE) AS day, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, 1000000 AS cap_micros FROM llm_usage WHERE workspace_id = 'w1' GROUP BY ALL HAVING sum(cost_micros) > 1000000 * 0.8", ("llm_usage",))
def daily(v):
    caps = v.spark.createDataFrame([("w0", 0), ("w1", 1_000_000)], "workspace_id string, cap_micros int")
    return ru.over_cap(v.llm_usage, caps, 0.8)


_RUN = "count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('queued', 'running')) AS open, CAST(sum(greatest(0, latency_ms)) AS BIGINT) AS busy_ms, count(DISTINCT company_id) FILTER (status = 'success') AS companies"


@query("a08_campaign_stats", f"SELECT campaign_id, {_RUN} FROM runs GROUP BY ALL", ("runs",))
def campaigns(v):
    return ru.run_stats(v.runs, "campaign_id")


@query("a09_source_stats", f"SELECT workspace_id, source, {_RUN} FROM runs GROUP BY ALL", ("runs",))
def sources(v):
    return ru.run_stats(v.runs, "workspace_id", "source")


@query("a10_duplicate_census", "SELECT workspace_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (e IS NOT NULL), 0) AS BIGINT) AS with_email, count(*) FILTER (e IS NOT NULL) AS distinct_emails, count(*) FILTER (e IS NOT NULL AND n > 1) AS n_groups, CAST(coalesce(sum(n) FILTER (e IS NOT NULL AND n > 1), 0) AS BIGINT) AS rows_in_groups, CAST(coalesce(sum(n - 1) FILTER (e IS NOT NULL AND n > 1), 0) AS BIGINT) AS surplus FROM (SELECT workspace_id, lower(email) AS e, count(*) AS n FROM contacts GROUP BY ALL) GROUP BY workspace_id", ("contacts",))
def duplicates(v):
    return ru.duplicate_census(v.contacts)


@query("a12_top_duplicates", "SELECT workspace_id, email, n, array_to_string(ids, ',') AS first_ids FROM (SELECT workspace_id, lower(email) AS email, count(*) AS n, list(id ORDER BY id)[1:5] AS ids FROM contacts WHERE email IS NOT NULL GROUP BY ALL HAVING count(*) > 1) ORDER BY n DESC, workspace_id, email LIMIT 10", ("contacts",))
def top(v):
    return ru.top_duplicates(v.contacts).withColumn("first_ids", F.array_join(F.col("first_ids").cast("array<string>"), ","))


@query("a13_legal_basis", "SELECT workspace_id, coalesce(nullif(trim(discovery_source), ''), '(none)') AS origin, count(*) AS total, count(*) FILTER (trim(legal_basis) <> '') AS with_basis, count(*) FILTER (coalesce(trim(legal_basis), '') = '') AS without_basis, round(count(*) FILTER (trim(legal_basis) <> '') * 100.0::DOUBLE / count(*), 2) AS percent FROM companies GROUP BY ALL", ("companies",))
def legal(v):
    return ru.legal_basis_census(v.companies)


@query("a14_failure_rate", "SELECT workspace_id, source, count(*) AS total, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'failed')::DOUBLE / count(*), 6) AS failure_rate FROM runs WHERE started_at >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL HAVING count(*) >= 20 AND count(*) FILTER (status = 'failed')::DOUBLE / count(*) > 0.15", ("runs",))
def failures(v):
    return ru.failure_anomalies(v.runs, "2024-01-15 00:00:00")


@query("a16_archive_reasons", "SELECT archive_reason, count(*) AS n, max(created_on) AS last_created FROM companies WHERE prospection_status = 'archived_no_email' GROUP BY ALL", ("companies",))
def reasons(v):
    return v.companies.where("prospection_status = 'archived_no_email'").groupBy("archive_reason").agg(F.count("*").alias("n"), F.max("created_on").alias("last_created"))


@query("a18_tag_usage", "SELECT w.slug, coalesce(n, 0) AS n FROM (SELECT unnest(['src:r', 'src:n', 'sect:a', 'geo:38']) AS slug) w LEFT JOIN (SELECT slug, count(*) AS n FROM company_tag GROUP BY slug) t ON w.slug = t.slug", (), COMPANY_TAG)
def tag_usage(v):
    return ru.closed_counts(v.company_tag, "slug", ("src:r", "src:n", "sect:a", "geo:38"))


@query("a19_prospection_stats", "SELECT coalesce(sector_main, '(unknown)') AS label, count(*) AS n FROM companies GROUP BY ALL ORDER BY n DESC, label LIMIT 10", ("companies",))
def prospection(v):
    return v.companies.groupBy(F.coalesce("sector_main", F.lit("(unknown)")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(10)


@query("a20_score_divergence", f"SELECT workspace_id, count(*) AS total, count(*) FILTER (quality_score IS DISTINCT FROM s) AS different, count(*) FILTER (quality_score < s) AS under, count(*) FILTER (quality_score > s) AS over FROM (SELECT c.workspace_id, c.quality_score, {SCORE_SQL} AS s FROM companies c) GROUP BY ALL", ("companies", "contacts"))
def divergence(v):
    return ru.divergence(scored(v), "quality_score", F.col("computed"))


_TIER = f"CASE WHEN domain IS NULL THEN NULL WHEN {_ROOT('domain')} IN ({_PUBLIC}) OR domain IN ({_PUBLIC}) THEN 'C' WHEN {_ROOT('domain')} = {_ROOT('host')} THEN 'A' ELSE 'B' END"


@query(
    "a21_best_confidence",
    f"""SELECT c.id, min(tier) AS best FROM companies c LEFT JOIN (SELECT id, {_TIER} AS tier FROM (SELECT c.id, {_DOMAIN('m.email')} AS domain, {_HOST('c.website')} AS host FROM companies c
 JOIN (SELECT company_id, email FROM contacts UNION ALL SELECT id, nullif(email_generic, '') FROM companies) m ON m.company_id = c.id WHERE m.email IS NOT NULL)) t ON t.id = c.id GROUP BY c.id""",
    ("companies", "contacts"),
)
def best(v):
    return ru.best_confidence(v.contacts, v.companies)


@query("a22_shared_emails", "SELECT workspace_id, lower(email) AS email, count(*) AS n FROM contacts WHERE email IS NOT NULL GROUP BY ALL HAVING count(*) > 3", ("contacts",))
def shared(v):
    return v.contacts.where(F.col("email").isNotNull()).groupBy("workspace_id", F.lower("email").alias("email")).agg(F.count("*").alias("n")).where("n > 3")


@query("a25_email_pattern", "SELECT domain, arg_min(pattern, (-n, pattern)) AS pattern FROM (SELECT string_split(lower(email), '@')[-1] AS domain, substr(lower(email), 1, 1) AS pattern, count(*) AS n FROM contacts WHERE email IS NOT NULL GROUP BY 1, 2) GROUP BY domain", ("contacts",))
def pattern(v):
    mail = F.lower("email")
    counts = v.contacts.where(F.col("email").isNotNull()).groupBy(F.substring_index(mail, "@", -1).alias("domain"), F.substring(mail, 1, 1).alias("pattern")).agg(F.count("*").alias("n"))
    return counts.groupBy("domain").agg(F.min_by("pattern", F.struct(-F.col("n"), F.col("pattern"))).alias("pattern"))


@query("a26_probes", "SELECT count(*) AS total, count(*) FILTER (email IS NOT NULL) AS keyed, count(*) FILTER (external_ref IS NOT NULL) AS referenced FROM contacts", ("contacts",))
def probes(v):
    return v.contacts.agg(F.count("*").alias("total"), F.count_if(F.col("email").isNotNull()).alias("keyed"), F.count_if(F.col("external_ref").isNotNull()).alias("referenced"))


@query("a27_success_rate", "SELECT workspace_id, round(count(*) FILTER (status = 'success') * 100.0::DOUBLE / nullif(count(*) FILTER (status IN ('success', 'failed')), 0), 1) AS success_rate FROM runs GROUP BY ALL", ("runs",))
def success(v):
    s = F.col("status")
    return v.runs.groupBy("workspace_id").agg(F.round(F.count_if(s == "success") * 100.0 / F.nullif(F.count_if(s.isin("success", "failed")), F.lit(0)), 1).alias("success_rate"))


@query("a28_list_total", "SELECT workspace_id, count(*) AS n FROM companies WHERE deleted_on IS NULL GROUP BY ALL", ("companies",))
def total(v):
    return v.companies.where(F.col("deleted_on").isNull()).groupBy("workspace_id").agg(F.count("*").alias("n"))


@query("a29_id_bounds", "SELECT min(id) AS low, max(id) AS high FROM companies", ("companies",))
def id_bounds(v):
    return v.companies.agg(F.min("id").alias("low"), F.max("id").alias("high"))


# --- changes of state

_FIRST = "batch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cppap_number ORDER BY row_no) AS r FROM media_batch WHERE present) WHERE r = 1)"


@query(
    "m01_source_merge",
    """SELECT coalesce(m.cppap_number, b.cppap_number) AS cppap_number, m.id, CASE WHEN b.r IS NOT NULL THEN b.name ELSE m.name END AS name, CASE WHEN b.r IS NOT NULL THEN b.publisher ELSE m.publisher END AS publisher,
 CASE WHEN b.r IS NOT NULL AND coalesce(m.email, '') = '' THEN coalesce(nullif(b.email, ''), m.email) ELSE m.email END AS email,
 CASE WHEN b.r IS NULL AND m.deleted_on IS NULL THEN DATE '2026-06-30' WHEN b.r IS NULL THEN m.deleted_on END AS deleted_on,
 CASE WHEN m.id IS NULL THEN 'inserted' WHEN b.r IS NOT NULL AND (m.name <> b.name OR m.publisher <> b.publisher OR coalesce(m.email, '') = '' OR m.deleted_on IS NOT NULL) THEN 'updated' WHEN b.r IS NOT NULL THEN 'unchanged' WHEN m.deleted_on IS NULL THEN 'archived' ELSE 'kept' END AS outcome,
 coalesce(m.id IS NOT NULL AND b.r IS NOT NULL AND m.deleted_on IS NOT NULL, false) AS revived
FROM media m FULL OUTER JOIN batch b ON m.cppap_number = b.cppap_number""",
    ("media", "media_batch"),
    _FIRST,
)
def source_merge(v):
    state = v.media.select("id", "cppap_number", "name", "publisher", "email", "deleted_on")
    return m.source_merge(state, v.media_batch.where("present"), "cppap_number", "row_no", ["name", "publisher"], ["email"], AS_OF)


_PRIORITY = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(m.RELATION_PRIORITY))
_STAGE = lambda c: f"CASE {c} WHEN 'qualifie' THEN 1 WHEN 'opportunite' THEN 2 WHEN 'client' THEN 3 ELSE 0 END"
_MERGED = lambda a, b: f"CASE WHEN {a} = 'perdu' THEN 'perdu' WHEN {a} = 'dormant' THEN CASE WHEN {b} = 'nouveau' THEN 'qualifie' ELSE {b} END WHEN {_STAGE(b)} > {_STAGE(a)} THEN {b} ELSE {a} END"


@query(
    "m04_priority_merges",
    f"""SELECT id, CASE WHEN CASE relation_type {_PRIORITY} END > 1 THEN 'prospect' ELSE relation_type END AS relation, {_MERGED('lifecycle_stage', "'opportunite'")} AS stage,
 CASE WHEN legal_basis IS NULL OR legal_basis = 'legitimate_interest_b2b' THEN 'precontractual' WHEN legal_basis IN ('contract', 'consent') THEN legal_basis ELSE 'precontractual' END AS basis FROM companies""",
    ("companies",),
)
def priorities(v):
    return v.companies.select("id", m.merge_relation(F.col("relation_type"), F.lit("prospect")).alias("relation"), m.merge_stage(F.col("lifecycle_stage"), F.lit("opportunite")).alias("stage"), m.merge_legal_basis(F.col("legal_basis"), F.lit("precontractual")).alias("basis"))


@query("m04_stage_fold", FOLD_SQL)
def fold(v):
    stage = F.element_at(F.array(*map(F.lit, ("nouveau", "qualifie", "dormant", "client", "opportunite", "qualifie", "perdu"))), (F.col("event_id") % 7 + 1).cast("int"))
    return m.fold_stages(v.events.withColumn("stage", stage), "user_id", "ts", "event_id", "stage")


@query("m05_ingest_once", "SELECT external_ref, min(id) AS id FROM activities WHERE occurred_at >= TIMESTAMP '2024-01-16 00:00:00' AND external_ref NOT IN (SELECT external_ref FROM activities WHERE occurred_at < TIMESTAMP '2024-01-16 00:00:00' AND external_ref IS NOT NULL) GROUP BY external_ref", ("activities",))
def once(v):
    """What came before a day is known, what came from then on is the batch."""
    known = F.col("occurred_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    return m.ingest_once(v.activities.where(known), v.activities.where(~known), "external_ref", "id").select("external_ref", "id")


@query("m08_retention", "SELECT id FROM contacts WHERE date_diff('day', created_on, DATE '2026-06-30') <= 600", ("contacts",))
def retention(v):
    return m.purge(v.contacts, F.datediff(F.lit(AS_OF).cast("date"), "created_on") > 600).select("id")


@query("m09_cold_prospects", "SELECT id FROM companies c WHERE NOT (relation_type = 'prospect' AND created_on < DATE '2025-07-01' AND id NOT IN (SELECT person_id FROM activities))", ("companies", "activities"))
def cold(v):
    active = v.activities.select(F.col("person_id").alias("_p")).distinct()
    flagged = v.companies.join(active, F.col("id") == F.col("_p"), "left")
    return m.purge(flagged, (F.col("relation_type") == "prospect") & (F.col("created_on") < F.lit("2025-07-01").cast("date")) & F.col("_p").isNull()).select("id")


@query("m13_tag_sync", "SELECT company_id, slug, 'add' AS action FROM (SELECT id AS company_id, 'sect:' || sector_main AS slug FROM companies WHERE sector_main IS NOT NULL) d WHERE NOT EXISTS (SELECT 1 FROM company_tag t WHERE t.company_id = d.company_id AND t.slug = d.slug) UNION ALL SELECT company_id, slug, 'remove' FROM company_tag t WHERE assigned_by = 'auto' AND slug NOT LIKE 'src:%' AND NOT EXISTS (SELECT 1 FROM companies c WHERE c.id = t.company_id AND 'sect:' || c.sector_main = t.slug)", ("companies",), COMPANY_TAG)
def tag_sync(v):
    desired = v.companies.where(F.col("sector_main").isNotNull()).select(F.col("id").alias("company_id"), F.concat(F.lit("sect:"), "sector_main").alias("slug"))
    return m.sync_tags(v.company_tag, desired)


@query("m14_set_stage", f"SELECT id, lifecycle_stage, s AS new_stage, s <> 'qualifie' AS refused FROM (SELECT id, lifecycle_stage, {_MERGED('lifecycle_stage', repr('qualifie'))} AS s FROM companies)", ("companies",))
def set_stage(v):
    return m.set_stage(v.companies, "qualifie")


@query("m17_quality_recompute", f"SELECT id, quality_score AS was, s AS becomes FROM (SELECT c.id, c.quality_score, {SCORE_SQL} AS s FROM companies c) WHERE quality_score IS DISTINCT FROM s", ("companies", "contacts"))
def recompute(v):
    return scored(v).where(~F.col("quality_score").eqNullSafe(F.col("computed"))).select("id", F.col("quality_score").alias("was"), F.col("computed").alias("becomes"))


@query("m27_site_status", "SELECT id, CASE WHEN id % 3 = 0 THEN 'found' WHEN id % 4 = 0 THEN 'dead' WHEN id % 4 = 1 AND id % 5 >= 2 THEN 'exhausted' WHEN id % 4 IN (1, 2) THEN 'not_found' ELSE 'exhausted' END AS status FROM media", ("media",))
def site(v):
    current = F.element_at(F.array(*map(F.lit, ("found", "not_found", "pending", "exhausted"))), (F.col("id") % 4 + 1).cast("int"))
    return v.media.select("id", m.site_status(current, F.col("id") % 3 == 0, F.col("id") % 5).alias("status"))


@query(
    "w01_audit_chain",
    """SELECT id, link_ok, hash_ok FROM (SELECT id, prev_hash = coalesce(lag(current_hash) OVER (ORDER BY id), repeat('0', 64)) AS link_ok, current_hash = sha256(prev_hash || '|' || payload_hash) AS hash_ok
 FROM (SELECT *, CASE WHEN id % 50 = 0 THEN 'x' ELSE sha256(prev_hash || '|' || payload_hash) END AS current_hash
 FROM (SELECT o_orderkey + 1 AS id, sha256((o_orderkey + 1)::VARCHAR) AS payload_hash, CASE WHEN o_orderkey % 2 = 0 THEN repeat('0', 64) ELSE sha256(repeat('0', 64) || '|' || sha256(o_orderkey::VARCHAR)) END AS prev_hash FROM orders)))
 WHERE NOT (link_ok AND hash_ok)""",
)
def chain(v):
    """A log that is linked by pairs of rows and whose every 50th row was altered; the rows that break it."""
    genesis, key = F.lit("0" * 64), F.col("id").cast("long")
    payload = lambda i: F.sha2(i.cast("string"), 256)
    rows = v.orders.select((F.col("o_orderkey") + 1).alias("id"))
    prev = F.when(key % 2 == 1, genesis).otherwise(F.sha2(F.concat(genesis, F.lit("|"), payload(key - 1)), 256))
    log = rows.withColumn("payload_hash", payload(key)).withColumn("prev_hash", prev)
    log = log.withColumn("current_hash", F.when(key % 50 == 0, "x").otherwise(F.sha2(F.concat("prev_hash", F.lit("|"), "payload_hash"), 256)))
    return m.verify_chain(log, shard=1000)


@query("p32_due_outbox", "SELECT event_id, least(60, CAST(pow(2, least(event_id % 9, 6)) AS INT)) AS wait FROM events WHERE event_type IN ('error', 'signup') AND ts <= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id LIMIT 100")
def outbox(v):
    due = v.events.where(F.col("event_type").isin("error", "signup") & (F.col("ts") <= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")))
    return due.orderBy("ts", "event_id").limit(100).select("event_id", k.backoff_minutes((F.col("event_id") % 9).cast("int")).alias("wait"))
