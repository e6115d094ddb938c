"""Queries of predicates, gates, joins, lists and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify as k
from ..operators import criteria as cr
from ..operators import relations as r
from ..sources.views import AS_OF, COMPANY_TAG
from .registry import query
from .scalars import _ACC, _NORM

CRITERIA = {
    "all": [{"field": "size_category", "op": "in", "value": ["PME", "TPE"]}, {"field": "quality_score", "op": "gte", "value": 20}],
    "any": [{"field": "sector_main", "op": "neq", "value": "building"}, {"field": "has_email", "op": "eq", "value": True}],
    "not": [{"field": "department_code", "op": "eq", "value": "38"}],
}
_MAIL = "(email_generic IS NOT NULL OR c.id IN (SELECT company_id FROM contacts WHERE email_status IN ('valid', 'catchall', 'unknown', 'role')))"
_WHERE = f"size_category IN ('PME', 'TPE') AND quality_score >= 20 AND ((sector_main <> 'building' OR sector_main IS NULL) OR {_MAIL}) AND NOT coalesce(department_code = '38', false)"
_TAGS = f", {COMPANY_TAG}".removeprefix(", ")


def _segment(v, criteria):
    return cr.segment(v.companies, v.contacts, v.company_tag, criteria)


@query("p01_audience", f"SELECT c.id FROM companies c WHERE {_WHERE}", ("companies", "contacts"))
def audience(v):
    return _segment(v, CRITERIA).select("id")


@query("a23_audience_preview", f"""SELECT (SELECT count(*) FROM seg) AS companies, (SELECT count(*) FROM contacts WHERE email_status IN ('valid', 'catchall', 'unknown', 'role') AND company_id IN (SELECT id FROM seg)) AS contacts,
 (SELECT count(*) FROM seg WHERE email_generic IS NOT NULL AND id NOT IN (SELECT company_id FROM contacts WHERE email_status IN ('valid', 'catchall', 'unknown', 'role'))) AS generic_only""", ("companies", "contacts"), f"seg AS (SELECT c.* FROM companies c WHERE {_WHERE})")
def preview(v):
    people = v.contacts.where(k.contactable(F.col("email_status"))).groupBy("company_id").agg(F.count("*").alias("n"))
    joined = _segment(v, CRITERIA).join(people, F.col("id") == F.col("company_id"), "left")
    return joined.agg(F.count("*").alias("companies"), F.coalesce(F.sum("n"), F.lit(0)).alias("contacts"), F.count_if(F.col("n").isNull() & F.col("email_generic").isNotNull()).alias("generic_only"))


@query("m15_audience_refresh", f"SELECT 7 AS audience_id, c.id AS company_id, t.id AS contact_id, c.workspace_id FROM companies c LEFT JOIN (SELECT * FROM contacts WHERE email_status IN ('valid', 'catchall', 'unknown', 'role')) t ON t.company_id = c.id WHERE {_WHERE}", ("companies", "contacts"))
def refresh(v):
    return cr.audience_members(_segment(v, CRITERIA), v.contacts, 7)


@query("a24_audience_size", f"SELECT workspace_id, count(*) AS members FROM (SELECT c.workspace_id, t.id FROM companies c LEFT JOIN (SELECT * FROM contacts WHERE email_status IN ('valid', 'catchall', 'unknown', 'role')) t ON t.company_id = c.id WHERE {_WHERE}) GROUP BY workspace_id", ("companies", "contacts"))
def audience_size(v):
    return refresh(v).groupBy("workspace_id").agg(F.count("*").alias("members"))


_CASES = {
    "p04_eq": ({"all": [{"field": "department_code", "op": "eq", "value": "38"}]}, "department_code = '38'"),
    "p04_in": ({"all": [{"field": "size_category", "op": "in", "value": ["PME", "ETI"]}]}, "size_category IN ('PME', 'ETI')"),
    "p04_ranges": ({"all": [{"field": "quality_score", "op": "gt", "value": 10}, {"field": "quality_score", "op": "lte", "value": 70}]}, "quality_score > 10 AND quality_score <= 70"),
    "p05_neq": ({"all": [{"field": "department_code", "op": "neq", "value": "38"}]}, "department_code IS DISTINCT FROM '38'"),
    "p05_not_in": ({"all": [{"field": "size_category", "op": "not_in", "value": ["PME", "GE"]}]}, "size_category IS NULL OR size_category NOT IN ('PME', 'GE')"),
    "p06_not_keeps_null": ({"not": [{"field": "department_code", "op": "eq", "value": "38"}, {"field": "sector_main", "op": "in", "value": ["building"]}]}, "department_code IS DISTINCT FROM '38' AND sector_main IS DISTINCT FROM 'building'"),
    "p07_tags": ({"all": [{"field": "tags", "op": "contains_any", "value": ["src:r", "sect:n"]}]}, "id IN (SELECT company_id FROM company_tag WHERE slug IN ('src:r', 'sect:n'))"),
    "p07_tags_empty": ({"all": [{"field": "tags", "op": "contains_any", "value": []}]}, "false"),
    "p08_no_email": ({"all": [{"field": "has_email", "op": "eq", "value": False}]}, f"NOT {_MAIL.replace('c.id', 'companies.id')}"),
    "p09_null": ({"all": [{"field": "sector_main", "op": "is_null"}, {"field": "department_code", "op": "is_not_null"}]}, "sector_main IS NULL AND department_code IS NOT NULL"),
}
for _name, (_criteria, _sql) in _CASES.items():
    query(_name, f"SELECT id FROM companies WHERE {_sql}", ("companies", "contacts"), COMPANY_TAG)(lambda v, c=_criteria: _segment(v, c).select("id"))

RULES = {
    "naf-62": {"field": "naf", "op": "starts_with", "value": "62"},
    "tech": {"field": "denomination", "op": "regex", "value": "/tech/i"},
    "good-pme": {"all": [{"field": "size_category", "op": "in", "value": ["PME", "ETI"]}, {"field": "quality_score", "op": ">=", "value": 50}]},
    "either": {"any": [{"field": "department_code", "op": "=", "value": "75"}, {"field": "city", "op": "ends_with", "value": "7"}]},
    "not-client": {"field": "relation_type", "op": "!=", "value": "client"},
    "unknown-op": {"field": "naf", "op": "almost", "value": "62"},
}


@query(
    "p11_tag_rules",
    """SELECT id AS company_id, slug FROM companies, (SELECT unnest(['naf-62', 'tech', 'good-pme', 'either', 'not-client']) AS slug) WHERE
 CASE slug WHEN 'naf-62' THEN naf LIKE '62%' WHEN 'tech' THEN denomination ILIKE '%tech%' WHEN 'good-pme' THEN size_category IN ('PME', 'ETI') AND quality_score >= 50 WHEN 'either' THEN department_code = '75' OR city LIKE '%7' ELSE relation_type <> 'client' END""",
    ("companies",),
)
def tag_rules(v):
    return cr.apply_rules(v.companies, RULES)


@query("j23_many_audiences", f"""SELECT id AS company_id, a AS audience_id FROM companies c, (SELECT unnest([1, 2, 3]) AS a) WHERE CASE a WHEN 1 THEN {_WHERE} WHEN 2 THEN department_code = '38' ELSE sector_main IS NULL END""", ("companies", "contacts"))
def many(v):
    return cr.many_audiences(v.companies, v.contacts, v.company_tag, {1: CRITERIA, 2: _CASES["p04_eq"][0], 3: {"all": [{"field": "sector_main", "op": "is_null"}]}})


_OPPOSED = "SELECT sha256(lower(trim(email))) FROM opt_out WHERE scope = 'business'"


@query("p12_opposition_gate", f"SELECT id, email FROM contacts WHERE email IS NULL OR sha256(lower(trim(email))) NOT IN ({_OPPOSED})", ("contacts", "opt_out"))
def opposition(v):
    return r.not_opposed(v.contacts, v.opt_out).select("id", "email")


@query("p13_campaign_eligible", f"SELECT id, best_email_confidence FROM companies WHERE email_generic <> '' AND deleted_on IS NULL AND best_email_confidence IN ('A', 'B') AND sha256(lower(trim(email_generic))) NOT IN ({_OPPOSED})", ("companies", "opt_out"))
def eligible(v):
    return r.campaign_eligible(v.companies, v.opt_out, ("A", "B")).select("id", "best_email_confidence")


@query("p14_list_filters", "SELECT id FROM companies WHERE department_code IN ('38', '75') AND size_category = 'PME'", ("companies",))
def filters(v):
    return r.list_filters(v.companies, {"department": "38,75", "size_category": "PME"}, {"department": "department_code"}).select("id")


@query("p15_date_bounds", "SELECT id FROM companies WHERE created_on >= DATE '2026-01-01' AND created_on <= DATE '2026-03-31'", ("companies",))
def bounds(v):
    return r.day_bounds(r.day_bounds(v.companies, "created_on", "2026-01-01", "2026-03-31"), "created_on", "no date", None).select("id")


@query("p16_all_tags", "SELECT id FROM companies WHERE id IN (SELECT company_id FROM company_tag WHERE slug = 'src:n') AND id IN (SELECT company_id FROM company_tag WHERE slug = 'sect:a')", ("companies",), COMPANY_TAG)
def all_tags(v):
    return r.with_all_tags(v.companies, v.company_tag, ["src:n", "sect:a"]).select("id")


@query("p17_taxonomy", "SELECT id, relation_type, lifecycle_stage FROM companies WHERE relation_type IN ('client', 'partenaire') AND lifecycle_stage = 'qualifie'", ("companies",))
def taxonomy(v):
    return r.list_filters(v.companies, {"relation_type": "client,partenaire", "lifecycle_stage": "qualifie"}).select("id", "relation_type", "lifecycle_stage")


@query("p18_name_search", f"SELECT id FROM companies WHERE contains({_NORM('denomination')}, 'cafe noel') OR contains({_NORM('denomination')}, '100%')", ("companies",))
def name_search(v):
    return r.name_contains(v.companies, "denomination", ["Café Noël", "100%"]).select("id")


@query("p19_hub_search", f"SELECT id FROM companies WHERE contains({_NORM('denomination')}, '0001') OR siren LIKE '0001%' OR id IN (SELECT company_id FROM contacts WHERE lower(last_name) LIKE '0001%' OR lower(email) LIKE '0001%')", ("companies", "contacts"))
def hub_search(v):
    return r.hub_search(v.companies, v.contacts, "0001").select("id")


_TAGGED = "c.id IN (SELECT company_id FROM company_tag WHERE slug LIKE 'src:%' AND assigned_by = 'user')"


@query("p20_temperature", f"SELECT id, CASE WHEN lifecycle_stage <> 'nouveau' OR {_TAGGED} THEN 'actifs' ELSE 'froids' END AS view FROM companies c", ("companies",), COMPANY_TAG)
def temperature(v):
    parts = [r.temperature(v.companies, v.company_tag, view).select("id", F.lit(view).alias("view")) for view in ("actifs", "froids")]
    return parts[0].unionByName(parts[1])


@query("p21_contacts_by_company", "SELECT id FROM contacts WHERE company_id IN (SELECT id FROM companies WHERE relation_type = 'client') AND lower(last_name) LIKE 'nom1%' AND email_status IN ('valid', 'catchall', 'unknown', 'role')", ("contacts", "companies"))
def contacts_by_company(v):
    return r.contacts_of(v.contacts, v.companies, F.col("relation_type") == "client").where(F.lower("last_name").startswith("nom1") & k.contactable(F.col("email_status"))).select("id")


@query("p22_media_filters", "SELECT id FROM media WHERE media_type IN ('economy', 'promo') AND name ILIKE '%widget%' AND email <> '' AND website IS NOT NULL", ("media",))
def media_filters(v):
    return r.list_filters(v.media, {"media_type": "economy,promo"}).where(F.col("name").ilike("%widget%") & (F.col("email") != "") & F.col("website").isNotNull()).select("id")


@query("p24_palette", f"""SELECT * FROM (SELECT 'company' AS kind, id, denomination AS label FROM companies WHERE contains({_NORM('denomination')}, 'acme') ORDER BY id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'contact' AS kind, id, last_name AS label FROM contacts WHERE contains({_NORM('last_name')}, 'acme') ORDER BY id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'media' AS kind, id, name AS label FROM media WHERE contains({_NORM('name')}, 'acme') ORDER BY id LIMIT 10)""", ("companies", "contacts", "media"))
def palette(v):
    out = None
    for kind, df, label in (("company", v.companies, "denomination"), ("contact", v.contacts, "last_name"), ("media", v.media, "name")):
        part = r.name_contains(df, label, ["acme"]).orderBy("id").limit(10).select(F.lit(kind).alias("kind"), "id", F.col(label).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


@query("p25_json_keys", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND json_extract(props, '$.siren') IS NULL")
def json_keys(v):
    return v.events.where(F.get_json_object("props", "$.k").isNotNull() & F.get_json_object("props", "$.siren").isNull()).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


_FRESH = "SELECT DISTINCT company_id, source FROM runs WHERE status = 'success' AND date_diff('day', CAST(started_at AS DATE), DATE '2024-02-10') < CASE source WHEN 'insee' THEN 30 WHEN 'bodacc' THEN 20 ELSE 15 END"


def _fresh(v):
    return r.fresh_runs(v.runs, {"insee": 30, "bodacc": 20}, 15, "2024-02-10")


@query("p26_freshness", _FRESH, ("runs",))
def freshness(v):
    return _fresh(v)


@query(
    "p28_scrape_gate",
    f"""SELECT c.id, CASE WHEN c.id IN (SELECT company_id FROM ({_FRESH}) WHERE source = 'insee') THEN 'fresh' WHEN sha256(lower(trim(email_generic))) IN (SELECT sha256(lower(trim(email))) FROM opt_out) THEN 'opted_out' WHEN department_code = '38' THEN 'cooldown' END AS reason FROM companies c""",
    ("companies", "runs", "opt_out"),
)
def gate(v):
    cooling = v.spark.createDataFrame([("38",)], "department_code string")
    return r.scrape_gate(v.companies.withColumn("source", F.lit("insee")), _fresh(v), v.opt_out, cooling).select("id", "reason")


@query("p29_enrich_list", "SELECT id FROM companies c WHERE enriched_on IS NULL OR (date_diff('day', enriched_on, DATE '2026-06-30') > 7 AND (lat IS NULL OR (email_generic IS NULL AND id NOT IN (SELECT company_id FROM contacts WHERE email IS NOT NULL))))", ("companies", "contacts"))
def enrich(v):
    return r.enrich_list(v.companies, v.contacts, AS_OF).select("id")


@query("p34_rescrape_list", "SELECT id FROM companies WHERE archive_reason = 'no_email' AND date_diff('day', created_on, DATE '2026-06-30') > 30 ORDER BY created_on, id LIMIT 50", ("companies",))
def rescrape(v):
    return v.companies.where((F.col("archive_reason") == "no_email") & (F.datediff(F.lit(AS_OF).cast("date"), "created_on") > 30)).orderBy("created_on", "id").limit(50).select("id")


# --- joins


@query("j01_coverage_dims", "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def dims(v):
    # both dimensions have a fixed number of rows: countries and continents
    joined = v.customer.join(F.broadcast(v.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(v.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"))


@query("j03_null_safe", "SELECT a.id, b.n FROM companies a LEFT JOIN (SELECT naf, size_category, count(*) AS n FROM companies GROUP BY naf, size_category) b ON a.naf IS NOT DISTINCT FROM b.naf AND a.size_category IS NOT DISTINCT FROM b.size_category", ("companies",))
def null_safe(v):
    counts = v.companies.groupBy(F.col("naf").alias("_n"), F.col("size_category").alias("_s")).agg(F.count("*").alias("n"))
    return v.companies.join(counts, F.col("naf").eqNullSafe(F.col("_n")) & F.col("size_category").eqNullSafe(F.col("_s")), "left").select("id", "n")


@query("j04_contacts_with_company", "SELECT t.id, c.denomination FROM contacts t LEFT JOIN companies c ON t.company_id = c.id AND c.deleted_on IS NULL", ("contacts", "companies"))
def with_company(v):
    live = v.companies.where(F.col("deleted_on").isNull()).select(F.col("id").alias("company_id"), "denomination")
    return v.contacts.join(live, "company_id", "left").select("id", "denomination")


@query("j08_not_extracted", "SELECT id FROM companies WHERE naf LIKE '58%' AND siren NOT IN (SELECT siren FROM media WHERE siren IS NOT NULL)", ("companies", "media"))
def not_extracted(v):
    return v.companies.where(F.col("naf").startswith("58") & F.col("siren").isNotNull()).join(v.media.select("siren"), "siren", "left_anti").select("id")


@query(
    "j11_link_unique_name",
    f"""SELECT m.id, coalesce(s.id, n.id) AS company_id, CASE WHEN s.id IS NOT NULL THEN 'siren' WHEN n.id IS NOT NULL THEN 'name' ELSE 'none' END AS linked_by FROM media m
LEFT JOIN (SELECT workspace_id, siren, min(id) AS id FROM companies WHERE siren IS NOT NULL GROUP BY ALL) s ON m.workspace_id = s.workspace_id AND m.siren = s.siren
LEFT JOIN (SELECT workspace_id, {_NORM('denomination')} AS norm, min(id) AS id FROM companies GROUP BY ALL HAVING count(*) = 1) n ON m.workspace_id = n.workspace_id AND {_NORM('m.name')} = n.norm""",
    ("media", "companies"),
)
def link(v):
    return r.link_unique_name(v.media, v.companies, "name").select("id", "company_id", "linked_by")


@query("j12_link_census", f"SELECT workspace_id, count(*) FILTER (n = 1) AS unique_names, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n IS NULL) AS without FROM (SELECT m.workspace_id, n.n FROM media m LEFT JOIN (SELECT workspace_id, {_NORM('denomination')} AS norm, count(*) AS n FROM companies GROUP BY ALL) n ON m.workspace_id = n.workspace_id AND {_NORM('m.name')} = n.norm) GROUP BY workspace_id", ("media", "companies"))
def census(v):
    return r.link_census(v.media, v.companies, "name")


_AGG = lambda x: f"regexp_replace(regexp_replace(trim(regexp_replace(lower(translate(coalesce({x}, ''), {_ACC})), '\\b(chaine de television|chaine tv|television|radio|tv)\\b', ' ', 'g')), '^(le|la|les|l)\\s+', ''), '[^a-z0-9]', '', 'g')"


@query("j13_link_programmes", f"SELECT p.p_partkey AS id, m.channel_id FROM part p LEFT JOIN (SELECT {_AGG('name')} AS key, min(id) AS channel_id FROM media GROUP BY 1 HAVING {_AGG('name')} <> '') m ON {_AGG('p.p_name')} = m.key", ("media",))
def programmes(v):
    return r.link_programmes(v.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), v.media).select("id", "channel_id")


@query("j14_inherit", "SELECT m.id, coalesce(nullif(m.email, ''), p.email) AS email, coalesce(nullif(m.website, ''), p.website) AS website, coalesce(nullif(m.phone, ''), p.phone) AS phone FROM media m LEFT JOIN media p ON m.parent_media_id = p.id", ("media",))
def inherit(v):
    return r.inherit(v.media).select("id", "email", "website", "phone")


@query(
    "j20_similar_names",
    f"""SELECT a_id, b_id, round(n / (an + bn - n), 6) AS similarity FROM (SELECT a.id AS a_id, b.id AS b_id, len(list_intersect(a.g, b.g))::DOUBLE AS n, len(a.g) AS an, len(b.g) AS bn
FROM grams a JOIN grams b ON a.workspace_id = b.workspace_id AND a.city = b.city AND a.id < b.id) WHERE round(n / (an + bn - n), 6) >= 0.85""",
    ("companies",),
    f"grams AS (SELECT id, workspace_id, city, list_distinct([substr('  ' || {_NORM('denomination')} || ' ', i, 3) FOR i IN range(1, length({_NORM('denomination')}) + 2)]) AS g FROM companies WHERE city IS NOT NULL)",
)
def similar(v):
    return r.similar_names(v.companies)


# --- pages and orders


@query("l01_sorted_page", "SELECT id, quality_score FROM companies ORDER BY quality_score DESC, id LIMIT 25 OFFSET 50", ("companies",))
def sorted_page(v):
    return v.companies.orderBy(F.desc("quality_score"), "id").offset(50).limit(25).select("id", "quality_score")


@query("l02_keyset_page", "SELECT id, enriched_on FROM companies WHERE enriched_on < DATE '2026-06-01' OR (enriched_on = DATE '2026-06-01' AND id < 900) OR enriched_on IS NULL ORDER BY enriched_on DESC NULLS LAST, id DESC LIMIT 21", ("companies",))
def keyset(v):
    return r.keyset_page(v.companies, "enriched_on", 20, (F.lit("2026-06-01").cast("date"), 900)).select("id", "enriched_on")


@query("l05_emptiest_zone", "SELECT department_code, count(*) AS companies FROM companies GROUP BY department_code ORDER BY count(*), department_code NULLS FIRST LIMIT 1", ("companies",))
def emptiest(v):
    return v.companies.groupBy("department_code").agg(F.count("*").alias("companies")).orderBy("companies", F.asc_nulls_first("department_code")).limit(1)


@query("l07_timeline", "SELECT person, universe, id, moment FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY moment DESC, universe, id) AS k FROM (SELECT person_id AS person, 'activity' AS universe, id, occurred_at AS moment FROM activities UNION ALL SELECT o_custkey AS person, 'contact' AS universe, o_orderkey AS id, o_orderdate AS moment FROM orders)) WHERE k <= 200", ("activities",))
def timeline(v):
    """Each person's latest 200 rows of both universes."""
    one = v.activities.select(F.col("person_id").cast("long").alias("person"), F.lit("activity").alias("universe"), "id", F.col("occurred_at").alias("moment"))
    two = v.orders.select(F.col("o_custkey").cast("long").alias("person"), F.lit("contact").alias("universe"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"))
    place = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("moment"), "universe", "id"))
    return one.unionByName(two).withColumn("k", place).where("k <= 200").drop("k")


@query("l09_zone_priority", "SELECT department_code, round((1 - complete / total) * (1 - exp(-date_diff('day', last_enriched, DATE '2026-06-30') / 30.0)), 6) AS priority FROM (SELECT department_code, count(*)::DOUBLE AS total, count(*) FILTER (quality_score >= 90) AS complete, max(enriched_on) AS last_enriched FROM companies WHERE department_code IS NOT NULL GROUP BY ALL) ORDER BY priority DESC, department_code LIMIT 50", ("companies",))
def zone_priority(v):
    zones = v.companies.where(F.col("department_code").isNotNull()).groupBy("department_code").agg(F.count("*").alias("t"), F.count_if(F.col("quality_score") >= 90).alias("c"), F.max("enriched_on").alias("d"))
    fresh = 1 - F.exp(-F.datediff(F.lit(AS_OF).cast("date"), "d") / 30.0)
    return zones.select("department_code", F.round((1 - F.col("c") / F.col("t")) * fresh, 6).alias("priority")).orderBy(F.desc("priority"), "department_code").limit(50)


@query("l10_export_cap", "SELECT count(*) AS n_rows, count(*) > 500 AS truncated FROM (SELECT id FROM companies LIMIT 501)", ("companies",))
def cap(v):
    return v.companies.select("id").limit(501).agg(F.count("*").alias("n_rows"), (F.count("*") > 500).alias("truncated"))


@query("l04_status_order", "SELECT id, row_number() OVER (PARTITION BY company_id ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, id) AS place FROM runs WHERE company_id IS NOT NULL", ("runs",))
def status_order(v):
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).when(F.col("status") == "failed", 2).otherwise(3)
    return v.runs.where(F.col("company_id").isNotNull()).select("id", F.row_number().over(Window.partitionBy("company_id").orderBy(rank, "id")).alias("place"))


@query("w02_first_wins", "SELECT cppap_number, arg_min(name, row_no) AS name FROM media_batch GROUP BY cppap_number", ("media_batch",))
def first_wins(v):
    return r.latest_first(v.media_batch, ["cppap_number"], F.asc("row_no")).select("cppap_number", "name")


@query("w03_best_per_person", "SELECT email, id FROM (SELECT lower(email) AS email, id, row_number() OVER (PARTITION BY lower(email) ORDER BY CASE email_status WHEN 'valid' THEN 0 WHEN 'catchall' THEN 1 ELSE 2 END, id) AS r FROM contacts WHERE email IS NOT NULL) WHERE r = 1", ("contacts",))
def best_person(v):
    rank = F.when(F.col("email_status") == "valid", 0).when(F.col("email_status") == "catchall", 1).otherwise(2)
    return r.latest_first(v.contacts.where(F.col("email").isNotNull()).withColumn("email", F.lower("email")), ["email"], rank, F.asc("id")).select("email", "id")


@query("w05_pacing", "SELECT id, (row_number() OVER (PARTITION BY source, company_id ORDER BY id) - 1) * 30 AS delay FROM runs WHERE status = 'queued'", ("runs",))
def pacing(v):
    return v.runs.where("status = 'queued'").select("id", ((F.row_number().over(Window.partitionBy("source", "company_id").orderBy("id")) - 1) * 30).cast("long").alias("delay"))


@query("w07_latest_end", "SELECT company_id, max(started_at) AS last_run FROM runs WHERE company_id IS NOT NULL GROUP BY company_id", ("runs",))
def latest_end(v):
    return v.runs.where(F.col("company_id").isNotNull()).groupBy("company_id").agg(F.max("started_at").alias("last_run"))


@query("u02_set_difference", "SELECT company_id, slug FROM company_tag WHERE assigned_by = 'auto' EXCEPT SELECT company_id, slug FROM company_tag WHERE slug LIKE 'src:%'", (), COMPANY_TAG)
def set_difference(v):
    tags = v.company_tag
    return tags.where("assigned_by = 'auto'").select("company_id", "slug").subtract(tags.where(F.col("slug").startswith("src:")).select("company_id", "slug"))
