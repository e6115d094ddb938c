"""Further queries: scoped reads, work-lists, reference lists, lifecycle and enrichment steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import contact as c
from ..functions import text as t
from ..operators import merge as m
from ..operators import relations as r
from ..sources.views import AS_OF, COMPANY_TAG
from .registry import query
from .scalars import _DEPT, _HOST, _NORM, _REGION, _ROOT, _SECTOR, _SIZE, SCORE_SQL


@query("s01_scoped_scan", "SELECT id, denomination FROM companies WHERE workspace_id = 'w1'", ("companies",))
def scoped(v):
    return v.scoped("w1").companies.select("id", "denomination")


@query("s04_live_rows", "SELECT workspace_id, count(*) AS live FROM companies WHERE deleted_on IS NULL GROUP BY ALL", ("companies",))
def live(v):
    return v.companies.where(F.col("deleted_on").isNull()).groupBy("workspace_id").agg(F.count("*").alias("live"))


@query("s13_fold_bindings", "SELECT CAST(l_partkey AS BIGINT) AS qid, max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS genre, count(DISTINCT CASE WHEN l_linenumber > 2 THEN l_linestatus || l_suppkey::VARCHAR END) AS people FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey")
def bindings(v):
    from ..sources.files import fold_bindings

    rows = v.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("qid"), F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).alias("genre"), F.col("l_linestatus").alias("role"), F.when(F.col("l_linenumber") > 2, F.col("l_suppkey").cast("string")).alias("person"))
    return fold_bindings(rows).select("qid", "genre", F.size("people").cast("long").alias("people"))


@query("p23_candidates", "SELECT id FROM contacts WHERE legal_basis = 'consent' AND (lower(last_name) LIKE 'nom2%' OR lower(email) LIKE 'q1%')", ("contacts",))
def candidates(v):
    return v.contacts.where((F.col("legal_basis") == "consent") & (F.lower("last_name").startswith("nom2") | F.lower("email").startswith("q1"))).select("id")


@query("p27_cooldown", "SELECT DISTINCT department_code FROM companies WHERE department_code IS NOT NULL AND created_on >= DATE '2026-06-29' AND naf LIKE '1%'", ("companies",))
def cooldown(v):
    return v.companies.where(F.col("department_code").isNotNull() & (F.col("created_on") >= F.lit("2026-06-29").cast("date")) & F.col("naf").startswith("1")).select("department_code").distinct()


@query("p36_due_campaigns", "SELECT campaign_id, min(started_at) AS first_due FROM runs WHERE status = 'queued' AND started_at <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY campaign_id", ("runs",))
def due(v):
    return v.runs.where((F.col("status") == "queued") & (F.col("started_at") <= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))).groupBy("campaign_id").agg(F.min("started_at").alias("first_due"))


@query("p37_revalidation", "SELECT id FROM media m WHERE website IS NOT NULL AND deleted_on IS NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.company_id = m.id AND r.status = 'success')", ("media", "runs"))
def revalidation(v):
    """Sites found that no run has looked at with success."""
    done = v.runs.where("status = 'success'").select(F.col("company_id").alias("_done")).distinct()
    found = v.media.where(F.col("website").isNotNull() & F.col("deleted_on").isNull())
    return found.join(done, F.col("id") == F.col("_done"), "left_anti").select("id")


@query("j02_department_fanout", "SELECT c.city, d.n FROM (SELECT DISTINCT city, substr(postcode, 1, 2) AS dep FROM companies WHERE city IS NOT NULL AND postcode IS NOT NULL) c JOIN (SELECT substr(postcode, 1, 2) AS dep, count(*) AS n FROM companies GROUP BY 1) d ON c.dep = d.dep", ("companies",))
def fanout(v):
    dep = F.substring("postcode", 1, 2)
    cities = v.companies.where(F.col("city").isNotNull() & F.col("postcode").isNotNull()).select("city", dep.alias("dep")).distinct()
    return cities.join(v.companies.groupBy(dep.alias("dep")).agg(F.count("*").alias("n")), "dep").select("city", "n")


@query("j05_person_view", "SELECT t.id, c.denomination, c.siren FROM contacts t LEFT JOIN companies c ON t.company_id = c.id", ("contacts", "companies"))
def person(v):
    side = v.companies.select(F.col("id").alias("company_id"), "denomination", "siren")
    return v.contacts.join(side, "company_id", "left").select("id", "denomination", "siren")


@query("j09_mark_join", "SELECT workspace_id, count(*) AS n FROM companies c WHERE lifecycle_stage <> 'nouveau' OR EXISTS (SELECT 1 FROM company_tag t WHERE t.company_id = c.id AND t.slug = 'src:r') GROUP BY ALL", ("companies",), COMPANY_TAG)
def mark(v):
    marked = v.company_tag.where("slug = 'src:r'").select(F.col("company_id").alias("_t")).distinct()
    return v.companies.join(marked, F.col("id") == F.col("_t"), "left").where((F.col("lifecycle_stage") != "nouveau") | F.col("_t").isNotNull()).groupBy("workspace_id").agg(F.count("*").alias("n"))


@query("j15_media_sync", "SELECT m.id, coalesce(c.website, m.website) AS website, CASE WHEN coalesce(m.phone, '') = '' THEN c.phone ELSE m.phone END AS phone FROM media m JOIN companies c ON m.siren = c.siren AND m.workspace_id = c.workspace_id", ("media", "companies"))
def media_sync(v):
    side = v.companies.select("siren", "workspace_id", F.col("website").alias("_w"), F.col("phone").alias("_p"))
    return v.media.join(side, ["siren", "workspace_id"]).select("id", F.coalesce("_w", "website").alias("website"), F.when(m.is_empty(F.col("phone")), F.col("_p")).otherwise(F.col("phone")).alias("phone"))


@query("j16_registry_by_name", f"SELECT p.p_partkey AS id, min(c.id) AS company_id FROM part p JOIN companies c ON {_NORM(repr('Acme Tech ') + ' || (p.p_partkey % 25)::VARCHAR')} = {_NORM('c.denomination')} GROUP BY p.p_partkey", ("companies",))
def by_name(v):
    # companies are first cut to one row for each name, so that a common name makes no product
    names = v.companies.groupBy(t.normalize_name(F.col("denomination")).alias("n")).agg(F.min("id").alias("company_id"))
    rows = v.part.select(F.col("p_partkey").alias("id"), t.normalize_name(F.concat(F.lit("Acme Tech "), (F.col("p_partkey") % 25).cast("string"))).alias("n"))
    return rows.join(names, "n").select("id", "company_id")


@query("j19_company_identity", "SELECT o_orderkey AS id, CASE WHEN c.id IS NOT NULL THEN 'siren' WHEN o_orderkey % 3 = 0 THEN 'foreign_id' ELSE 'pending_match' END AS anchor, c.id AS company_id FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lpad((o_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') END AS siren, 'w' || (o_custkey % 2)::VARCHAR AS workspace_id FROM orders) o LEFT JOIN companies c ON o.siren = c.siren AND o.workspace_id = c.workspace_id", ("companies",))
def identity(v):
    number = F.lpad((F.col("o_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    incoming = v.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, number).alias("siren"), F.concat(F.lit("w"), (F.col("o_custkey") % 2).cast("string")).alias("workspace_id"))
    known = v.companies.where(F.col("siren").isNotNull()).select("siren", "workspace_id", F.col("id").alias("company_id"))
    anchor = F.when(F.col("company_id").isNotNull(), "siren").when(F.col("id") % 3 == 0, "foreign_id").otherwise("pending_match")
    return incoming.join(known, ["siren", "workspace_id"], "left").select("id", anchor.alias("anchor"), "company_id")


@query("a11_group_consistency", "SELECT workspace_id, CAST(sum(n) - count(*) AS BIGINT) AS surplus FROM (SELECT workspace_id, lower(email) AS e, count(*) AS n FROM contacts WHERE email IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY workspace_id", ("contacts",))
def consistency(v):
    groups = v.contacts.where(F.col("email").isNotNull()).groupBy("workspace_id", F.lower("email").alias("e")).agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy("workspace_id").agg((F.sum("n") - F.count("*")).alias("surplus"))


@query("a17_quota", "SELECT workspace_id, count(*) AS used, round(count(*) * 100.0::DOUBLE / 400, 2) AS percent FROM runs WHERE started_at >= TIMESTAMP '2024-01-01 00:00:00' AND started_at < TIMESTAMP '2024-02-01 00:00:00' GROUP BY ALL", ("runs",))
def quota(v):
    month = v.runs.where((F.col("started_at") >= F.lit("2024-01-01").cast("timestamp_ntz")) & (F.col("started_at") < F.lit("2024-02-01").cast("timestamp_ntz")))
    return month.groupBy("workspace_id").agg(F.count("*").alias("used")).withColumn("percent", F.round(F.col("used") * 100.0 / 400, 2))


@query("l06_least_loaded", "SELECT source, count(*) AS load FROM runs GROUP BY source ORDER BY count(*) / CASE source WHEN 'insee' THEN 3.0 ELSE 1.0 END, source LIMIT 1", ("runs",))
def least_loaded(v):
    weight = F.when(F.col("source") == "insee", 3.0).otherwise(1.0)
    return v.runs.groupBy("source").agg(F.count("*").alias("load")).orderBy(F.col("load") / weight, "source").limit(1)


@query("l08_recheck_order", "SELECT id, enriched_on FROM companies ORDER BY enriched_on NULLS FIRST, id LIMIT 40", ("companies",))
def recheck(v):
    return v.companies.orderBy(F.asc_nulls_first("enriched_on"), "id").limit(40).select("id", "enriched_on")


@query("l11_tag_list", "SELECT DISTINCT slug, split_part(slug, ':', 1) AS namespace FROM company_tag ORDER BY namespace, slug LIMIT 500", (), COMPANY_TAG)
def tag_list(v):
    return v.company_tag.select("slug", F.substring_index("slug", ":", 1).alias("namespace")).distinct().orderBy("namespace", "slug").limit(500)


@query("l12_latest_versions", "SELECT use_case_slug, provider, max(created_at) AS latest FROM llm_usage GROUP BY ALL", ("llm_usage",))
def versions(v):
    return v.llm_usage.groupBy("use_case_slug", "provider").agg(F.max("created_at").alias("latest"))


@query("l13_reference_list", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def reference(v):
    return v.nation.join(F.broadcast(v.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # as many rows as continents


@query("u04_skipped_ids", "SELECT id FROM (SELECT unnest([1, 5, 999999999, 7]) AS id) WHERE id NOT IN (SELECT c_custkey FROM customer)")
def skipped(v):
    asked = v.spark.createDataFrame([(1,), (5,), (999999999,), (7,)], "id int")
    return asked.join(v.customer.select(F.col("c_custkey").alias("id")), "id", "left_anti")


@query("u05_channel_union", f"SELECT c.id, array_to_string(list_sort(list_distinct(list_concat(coalesce(e, []), CASE WHEN email_generic <> '' THEN [lower(email_generic)] ELSE [] END))), ' ') AS channels FROM companies c LEFT JOIN (SELECT company_id, list(DISTINCT lower(email)) AS e FROM contacts WHERE email IS NOT NULL GROUP BY company_id) t ON c.id = t.company_id", ("companies", "contacts"))
def channels(v):
    mails = v.contacts.where(F.col("email").isNotNull()).groupBy("company_id").agg(F.collect_set(F.lower("email")).alias("e"))
    own = F.when(F.col("email_generic") != "", F.array(F.lower("email_generic"))).otherwise(F.array().cast("array<string>"))
    joined = v.companies.join(mails, F.col("id") == F.col("company_id"), "left")
    return joined.select("id", F.array_join(F.sort_array(F.array_union(F.coalesce("e", F.array().cast("array<string>")), own)), " ").alias("channels"))


@query("f14_like_escape", "SELECT p_partkey AS id, replace(replace(replace(p_name || '_%', chr(92), chr(92) || chr(92)), '%', chr(92) || '%'), '_', chr(92) || '_') AS pattern FROM part")
def like(v):
    return v.part.select(F.col("p_partkey").alias("id"), t.like_escape(F.concat("p_name", F.lit("_%"))).alias("pattern"))


@query("f27_redaction_email", "SELECT id, CASE WHEN email LIKE 'redaction@%' THEN email END AS redaction FROM media", ("media",))
def redaction(v):
    return v.media.select("id", F.when(F.substring_index("email", "@", 1).isin("redaction", "presse", "contact"), F.col("email")).alias("redaction"))


@query("f33_commune", "SELECT id, CASE WHEN id % 2 = 0 AND length(postcode) = 5 THEN postcode WHEN id % 3 = 0 THEN '75056' END AS commune FROM companies", ("companies",))
def commune(v):
    from ..functions.classify import commune as place

    return v.companies.select("id", place(F.when(F.col("id") % 2 == 0, F.col("postcode")), F.when(F.col("id") % 3 == 0, "75056")).alias("commune"))


@query("m11_non_diffusible", "SELECT id FROM companies WHERE NOT coalesce(naf LIKE '94%' OR naf LIKE '84%', false)", ("companies",))
def diffusible(v):
    return m.purge(v.companies, F.col("naf").startswith("94") | F.col("naf").startswith("84")).select("id")


@query("m16_src_backfill", "SELECT id AS company_id, 'src:' || coalesce(nullif(trim(discovery_source), ''), 'unknown') AS slug FROM companies WHERE id NOT IN (SELECT company_id FROM company_tag WHERE slug LIKE 'src:%')", ("companies",), COMPANY_TAG)
def backfill(v):
    have = v.company_tag.where(F.col("slug").startswith("src:")).select(F.col("company_id").alias("id"))
    source = F.coalesce(F.when(F.trim("discovery_source") != "", F.trim("discovery_source")), F.lit("unknown"))
    return v.companies.join(have, "id", "left_anti").select(F.col("id").alias("company_id"), F.concat(F.lit("src:"), source).alias("slug"))


@query("m18_key_backfill", "SELECT count(*) AS n_rows, count(email) AS keyed, count(DISTINCT lower(trim(email))) AS persons FROM contacts", ("contacts",))
def key_backfill(v):
    key = c.person_key(F.col("email"), "pepper")
    return v.contacts.select(key.alias("k")).agg(F.count("*").alias("n_rows"), F.count("k").alias("keyed"), F.count_distinct("k").alias("persons"))


@query("m21_extract_media", "SELECT id, denomination AS name, substr(naf, 1, 4) AS branch FROM companies WHERE naf LIKE '58%' OR naf LIKE '59%' OR naf LIKE '60%'", ("companies",))
def extract_media(v):
    return v.companies.where(F.substring("naf", 1, 2).isin("58", "59", "60")).select("id", F.col("denomination").alias("name"), F.substring("naf", 1, 4).alias("branch"))


@query("m24_outbox", "SELECT event_id, CASE WHEN event_id % 9 >= 7 THEN 'given_up' WHEN event_id % 2 = 0 THEN 'sent' ELSE 'failed' END AS status FROM events WHERE event_type = 'purchase'")
def outbox(v):
    attempts = F.col("event_id") % 9
    return v.events.where("event_type = 'purchase'").select("event_id", F.when(attempts >= 7, "given_up").when(F.col("event_id") % 2 == 0, "sent").otherwise("failed").alias("status"))


@query("m28_media_mail", f"SELECT m.id, CASE WHEN coalesce(m.email, '') = '' THEN 'contact@' || {_ROOT(_HOST('m.website'))} ELSE m.email END AS email FROM media m", ("media",))
def media_mail(v):
    guess = F.concat(F.lit("contact@"), c.registrable(c.site_host(F.col("website"))))
    return v.media.select("id", F.when(m.is_empty(F.col("email")), guess).otherwise(F.col("email")).alias("email"))


@query("m30_opt_out_once", "SELECT DISTINCT scope, sha256(lower(trim(email))) AS email_hash FROM opt_out", ("opt_out",))
def opt_out_once(v):
    return v.opt_out.select("scope", c.fingerprint(F.col("email")).alias("email_hash")).dropDuplicates()


@query("m32_version_token", "SELECT id, id % 3 = 0 AS refused FROM companies", ("companies",))
def token(v):
    version = F.md5(F.concat_ws("|", F.col("id").cast("string"), "denomination"))
    sent = F.when(F.col("id") % 3 == 0, "stale").otherwise(version)
    return v.companies.select("id", (sent != version).alias("refused"))


@query("m33_programme_status", "SELECT person_id, CASE WHEN max(occurred_at) < TIMESTAMP '2024-01-25 00:00:00' THEN 'ended' ELSE 'running' END AS status FROM activities GROUP BY person_id", ("activities",))
def programme(v):
    return v.activities.groupBy("person_id").agg(F.when(F.max("occurred_at") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), "ended").otherwise("running").alias("status"))


@query("k06_bulk_update", "SELECT c.id, coalesce(b.phone, c.phone) AS phone FROM companies c LEFT JOIN (SELECT s_suppkey AS id, 'new' || s_suppkey::VARCHAR AS phone FROM supplier) b ON c.id = b.id", ("companies",))
def bulk(v):
    batch = v.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("_p"))
    return v.companies.join(batch, "id", "left").select("id", F.coalesce("_p", "phone").alias("phone"))


@query("k07_insert_or_ignore", "SELECT cppap_number FROM media_batch WHERE cppap_number NOT IN (SELECT cppap_number FROM media) GROUP BY cppap_number", ("media_batch", "media"))
def ignore(v):
    return m.ingest_once(v.media, v.media_batch, "cppap_number", "row_no").select("cppap_number")


@query("w04_same_company_first", "SELECT email, arg_min(id, CASE WHEN company_id % 2 = 0 THEN 0 ELSE 1 END * 1000000000000 + id) AS id FROM (SELECT lower(email) AS email, id, company_id FROM contacts WHERE email IS NOT NULL) GROUP BY email", ("contacts",))
def same_company(v):
    rows = v.contacts.where(F.col("email").isNotNull()).select(F.lower("email").alias("email"), "id", "company_id")
    return r.latest_first(rows, ["email"], F.when(F.col("company_id") % 2 == 0, 0).otherwise(1), F.asc("id")).select("email", "id")


@query("a02_recent_rows", "SELECT workspace_id, count(*) AS recent FROM companies WHERE created_on >= DATE '2026-06-23' GROUP BY ALL", ("companies",))
def recent(v):
    return v.companies.where(F.datediff(F.lit(AS_OF).cast("date"), "created_on") <= 7).groupBy("workspace_id").agg(F.count("*").alias("recent"))


@query("j21_series", "SELECT r_regionkey, s AS step FROM region, (SELECT unnest([1, 2, 3]) AS s)")
def series(v):
    return v.region.select("r_regionkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step"))


@query("w08_rank_in_sector", "SELECT id, rank() OVER (PARTITION BY sector_main, workspace_id ORDER BY quality_score DESC) AS place FROM companies WHERE sector_main IS NOT NULL", ("companies",))
def rank(v):
    return v.companies.where(F.col("sector_main").isNotNull()).select("id", F.rank().over(Window.partitionBy("sector_main", "workspace_id").orderBy(F.desc("quality_score"))).alias("place"))


@query(
    "m22_waterfall",
    f"""SELECT c.id, department, CASE {_REGION} END AS region, CASE WHEN naf IS NULL THEN NULL {_SECTOR} ELSE 'autre' END AS sector, CASE {_SIZE} END AS size, score, CASE WHEN score >= 90 THEN 'complete' WHEN score >= 50 THEN 'partielle' ELSE 'basique' END AS badge,
CASE WHEN coalesce(archive_reason = 'entreprise_radiee', false) THEN 'archived_no_email' WHEN email_generic <> '' OR c.id IN (SELECT company_id FROM contacts WHERE email_status IN ('valid', 'catchall', 'unknown', 'role')) THEN 'ready_for_outreach' ELSE 'archived_no_email' END AS status
FROM (SELECT c.*, {_DEPT} AS department, {_DEPT} AS d0, try_cast(substr(naf, 1, 2) AS INT) AS dn, {SCORE_SQL} AS score FROM companies c) c""".replace("WHEN d IN", "WHEN d0 IN").replace("WHEN d BETWEEN", "WHEN dn BETWEEN"),
    ("companies", "contacts"),
)
def waterfall(v):
    from ..operators.waterfall import derive

    return derive(v.companies, v.contacts).select("id", "department", "region", "sector", "size", "score", "badge", "status")


@query("m29_people_in_replies", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'NOM' || doc_id::VARCHAR ELSE '' END AS people FROM documents")
def people(v):
    from ..operators.waterfall import parse_people

    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('Here:\n```json\n[{"first_name":"A","last_name":" NOM'), F.col("doc_id").cast("string"), F.lit('","role":"x"},{"last_name":" "}]\n```'))).otherwise("no people found")
    return v.documents.select("doc_id", F.array_join(F.transform(parse_people(reply), lambda p: p["last_name"]), " ").alias("people"))


@query("st_sliding_windows", "SELECT s AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS s FROM events) GROUP BY ALL")
def sliding(v):
    from ..streaming import ingest
    from .feeds import _stream, scratch

    stream = ingest.windowed_counts(_stream(v).withColumn("ts", F.col("ts").cast("timestamp")), size="2 days", slide="1 day")
    table = ingest.run_to_table(stream, v.spark, scratch(v.spark), "update")
    return table.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.max_by("n", "epoch").alias("n"))
