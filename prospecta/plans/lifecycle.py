"""Queries of moving records; their inputs are dealt over a table so that every branch is reached, and the twins say each answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as y
from .registry import query


def _dealt(key: str, rows: list[tuple], names: tuple[str, ...]):
    """One of some fixed rows for each row of a table, by its key."""
    cells = F.array(*[F.struct(*[(F.lit(x).cast("string") if x is None or isinstance(x, str) else F.lit(x)).alias(n) for n, x in zip(names, row, strict=True)]) for row in rows])
    return F.element_at(cells, (F.col(key) % len(rows)).cast("int") + 1)


_EVENTS = [
    ("newsletter_optin", None, None), ("newsletter_optout", None, None), ("review_posted", None, None), ("form_submission", "partenariat", None), ("form_submission", "presse", None), ("form_submission", "investisseur", None),
    ("form_submission", "speaker", None), ("form_submission", "audit", "landing"), ("form_submission", "un_a_un", None), ("form_submission", "contact", None), ("calendly_booked", None, None), ("calendly_completed", None, None),
    ("calendly_canceled", None, None), ("calendly_no_show", None, None), ("other", None, None), ("form_submission", "formation", None),
]


@query(
    "f38_event_rules",
    """SELECT c_custkey AS id, e[1] AS relation, e[2] AS stage, e[3] AS basis, e[4] AS tags FROM (SELECT c_custkey, string_split([
'newsletter|qualifie|consent|src:newsletter', 'newsletter|qualifie|consent|src:newsletter', 'client|client|precontractual|src:avis-client', 'partenaire|qualifie|precontractual|src:site-formulaire-partenariat',
'presse_media|qualifie|precontractual|src:site-formulaire-presse', 'investisseur|qualifie|precontractual|src:site-formulaire-investisseur', 'conference|qualifie|precontractual|src:site-formulaire-speaker svc:conference',
'prospect|opportunite|precontractual|src:landing svc:audit', 'prospect|opportunite|precontractual|src:site-formulaire-un-a-un', 'prospect|qualifie|precontractual|src:site-formulaire-contact',
'prospect|opportunite|precontractual|src:calendly', 'prospect|opportunite|precontractual|src:calendly', 'prospect|qualifie|precontractual|src:calendly', 'prospect|qualifie|precontractual|src:calendly',
'prospect|qualifie|precontractual|src:site-formulaire-autre', 'prospect|opportunite|precontractual|src:site-formulaire-formation svc:formation'][c_custkey % 16 + 1], '|') AS e FROM customer)""",
)
def event_rules(v):
    e = _dealt("c_custkey", _EVENTS, ("kind", "form", "source"))
    none = F.lit(None).cast("string")
    tags = y.event_tags(e["kind"], e["form"], e["source"], none, F.lit(None).cast("array<string>"))
    return v.customer.select(F.col("c_custkey").alias("id"), y.event_relation(e["kind"], e["form"]).alias("relation"), y.event_stage(e["kind"], e["form"]).alias("stage"), y.event_basis(e["kind"]).alias("basis"), F.array_join(tags, " ").alias("tags"))


@query(
    "m24_enqueue",
    """SELECT min(event_id) AS event_id, 'h' || (user_id % 50)::VARCHAR AS email_hash, 'consent_optout' AS event_type FROM events
WHERE event_type = 'click' AND user_id % 50 > 0 AND 'h' || (user_id % 50)::VARCHAR NOT IN (SELECT 'h' || (s_suppkey % 97)::VARCHAR FROM supplier WHERE s_suppkey % 3 < 2) GROUP BY user_id % 50""",
)
def outbox_enqueue(v):
    """Clicks as opt-outs, purchases as an unknown type, views of foreign origin; two of three suppliers' rows are still waiting."""
    mail = F.when(F.col("user_id") % 50 == 0, " ").otherwise(F.concat(F.lit("h"), (F.col("user_id") % 50).cast("string"), F.lit(" ")))
    kind = F.when(F.col("event_type") == "purchase", "greeting").otherwise("consent_optout")
    origin = F.when(F.col("event_type").isin("click", "purchase"), "crm").otherwise("site")
    asked = v.events.select("event_id", kind.alias("event_type"), mail.alias("email_hash"), F.lit("business").alias("scope"), origin.alias("origin"))
    status = F.element_at(F.array(*map(F.lit, ("pending", "failed", "sent"))), (F.col("s_suppkey") % 3).cast("int") + 1)
    box = v.supplier.select(F.lit("consent_optout").alias("event_type"), F.concat(F.lit("h"), (F.col("s_suppkey") % 97).cast("string")).alias("email_hash"), F.lit("business").alias("scope"), status.alias("status"))
    return y.enqueue(box, asked, "event_id").select("event_id", "email_hash", "event_type")


_CODES = (200, 204, 422, 0, 408, 429, 502, 503, 504, 500, 404)


@query(
    "m24_after_reply",
    """SELECT event_id, CASE WHEN c < 2 THEN 'sent' WHEN c = 2 THEN 'gave_up' WHEN c < 9 THEN 'deferred' WHEN a >= 7 THEN 'gave_up' ELSE 'failed' END AS status, CASE WHEN c BETWEEN 3 AND 8 THEN a ELSE a + 1 END AS attempts,
CASE WHEN c BETWEEN 3 AND 8 THEN [1, 2, 4, 8, 16, 32, 60, 60, 60][a + 1] WHEN c >= 9 AND a < 7 THEN [2, 4, 8, 16, 32, 60, 60][a + 1] END AS minutes
FROM (SELECT event_id, event_id % 11 AS c, (event_id // 11 % 9)::INT AS a FROM events)""",
)
def outbox_reply(v):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 11).cast("int") + 1)
    attempts = (F.floor(F.col("event_id") / 11) % 9).cast("int")
    after = y.after_reply(code, attempts, F.col("ts").cast("timestamp"))
    minutes = ((F.unix_timestamp(F.col("a.next_attempt_at")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 60).cast("int")
    return v.events.withColumn("a", after).select("event_id", F.col("a.status").alias("status"), F.col("a.attempts").alias("attempts"), minutes.alias("minutes"))


@query("m32_stale_writes", "SELECT id, id % 6 = 1 OR (id % 6 = 5 AND quality_score IS NOT NULL) AS refused FROM companies", ("companies",))
def stale_writes(v):
    """Tokens of no, another, any, the same, a listed and an older version of each company, compared with the current one."""
    current = y.version_token("id", "denomination", "quality_score")
    rows = v.companies.withColumn("now", current)
    before = rows.withColumn("quality_score", F.col("quality_score") + 1).select("id", current.alias("before"))
    forms = (F.lit(None).cast("string"), F.lit('"0123"'), F.lit("*"), F.concat(F.lit('"'), F.col("now"), F.lit('"')), F.concat(F.lit('"x", "'), F.col("now"), F.lit('"')), F.col("before"))
    sent = F.element_at(F.array(*forms), (F.col("id") % 6).cast("int") + 1)
    return rows.join(before, "id").select("id", y.stale(sent, F.col("now")).alias("refused"))


@query(
    "m33_ended_programmes",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'old' WHEN e.d IS NULL THEN NULL ELSE e.d::VARCHAR END AS ended_at, CASE WHEN s_suppkey % 4 > 0 THEN 'kept' END AS other, s_suppkey % 4 > 1 AS checked
FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_shipdate)::DATE AS d FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1) e ON l_suppkey = s_suppkey""",
)
def ended_programmes(v):
    """Suppliers as programmes: without JSON, with an id that isn't one, and with one; a third has end dates."""
    qid = F.when(F.col("s_suppkey") % 4 == 1, "none").otherwise(F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")))
    doc = F.to_json(F.struct(qid.alias("wikidata_id"), F.lit("old").alias("ended_at"), F.lit("kept").alias("other")))
    media = v.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 != 0, doc).alias("socials"))
    ends = v.lineitem.where("l_suppkey % 3 = 0").select(F.concat(F.lit("Q"), F.col("l_suppkey").cast("string")).alias("qid"), F.col("l_shipdate").cast("date").alias("ended_on"))
    read = lambda key: F.get_json_object("socials", f"$.{key}")
    marked = y.mark_ended(media, ends, "2026-06-30T00:00:00+00:00")
    return marked.select("id", read("ended_at").alias("ended_at"), read("other").alias("other"), read("wikidata_status_checked_at").isNotNull().alias("checked"))


_HARVESTS = [
    ("noise@sentry.io contact@agence.fr info@journal.fr", "https://www.journal.fr/"), ("jean@journal.fr redaction@journal.fr", "journal.fr"), ("votre@journal.fr 0123456789abcdef0@journal.fr", "journal.fr"), ("jean@ailleurs.fr la.presse@ailleurs.fr", "journal.fr"),
    ("logo.png@journal.fr x@sedoparking.com b@autre.fr a@autre.fr", "journal.fr"), ("", "journal.fr"), ("x@monsite.fr y@example.com z@gmail.com", None), ("jean@journal.fr paul@journal.fr", "http://journal.fr"),
]


@query("m28_office_email", "SELECT c_custkey AS id, ['info@journal.fr', 'redaction@journal.fr', NULL, 'la.presse@ailleurs.fr', 'b@autre.fr', NULL, 'z@gmail.com', 'jean@journal.fr'][c_custkey % 8 + 1] AS email FROM customer")
def office_email(v):
    h = _dealt("c_custkey", _HARVESTS, ("emails", "website"))
    emails = F.filter(F.split(h["emails"], " "), lambda e: e != "")
    return v.customer.select(F.col("c_custkey").alias("id"), y.office_email(emails, h["website"]).alias("email"))


_NAMES = [
    ("DACIA ROMANIA SRL", "Dacia"), ("L'Oréal S.A.", "LOREAL"), ("SAS Renault - Bucuresti", "SAS RENAULT INDUSTRIES"), ("Société Générale Europe", "SOCIETE GENERALES"), ("Paris", "PARIS"), ("Saint-Gobain  SE", "SAINT GOBAIN"), ("Atos IT", "AT"), ("", "X"),
]


@query(
    "f42_registry_names",
    """SELECT c_custkey AS id, ['DACIA', 'L''OREAL', 'SAS RENAULT', 'SOCIETE GENERALE', 'PARIS', 'SAINT-GOBAIN', 'ATOS IT', ''][c_custkey % 8 + 1] AS base,
c_custkey % 8 IN (0, 1, 2, 4, 5) AS accepted FROM customer""",
)
def registry_names(v):
    n = _dealt("c_custkey", _NAMES, ("name", "found"))
    base = y.registry_base(n["name"])
    return v.customer.select(F.col("c_custkey").alias("id"), base.alias("base"), y.registry_match(base, n["found"]).alias("accepted"))


_STATIONS = [("Radio", "A"), ("radio ", " b"), ("RADIO", "C"), ("Radio", "D"), ("Radio", "e"), ("Radio", "NC"), ("TV", "A"), ("Télévision", "C"), ("television", None), ("presse", "A"), (None, "A"), ("Radio", None)]


@query("f35_zone_and_kind", "SELECT c_custkey AS id, CASE WHEN c_custkey % 12 < 6 OR c_custkey % 12 = 11 THEN 'radio' WHEN c_custkey % 12 < 9 THEN 'tv' END AS kind, ['local', 'local', 'régional', 'national', 'national'][c_custkey % 12 + 1] AS zone FROM customer")
def zone_and_kind(v):
    s = _dealt("c_custkey", _STATIONS, ("nature", "category"))
    kind = y.broadcast_kind(s["nature"])
    return v.customer.select(F.col("c_custkey").alias("id"), kind.alias("kind"), y.diffusion_zone(kind, s["category"]).alias("zone"))


@query("m21_media_not_known", "SELECT id, denomination AS name FROM companies c WHERE (naf LIKE '58%' OR naf LIKE '59%' OR naf LIKE '60%') AND NOT EXISTS (SELECT 1 FROM media m WHERE m.siren = c.siren)", ("companies", "media"))
def media_not_known(v):
    """Companies of the media's branches that no medium belongs to yet."""
    known = v.media.where(F.col("siren").isNotNull()).select("siren")
    return v.companies.where(F.substring("naf", 1, 2).isin("58", "59", "60")).join(known, "siren", "left_anti").select("id", F.col("denomination").alias("name"))
