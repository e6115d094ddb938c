"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as k
from ..functions import contact as c
from ..functions import text as t
from .registry import query

_ACC = f"'{t.ACCENTED}', '{t.PLAIN}'"
_NORM = lambda x: f"lower(regexp_replace(translate(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'), {_ACC}), '\\b({'|'.join(t.ARTICLES)})\\b\\s+', '', 'gi'))"
_HOST = lambda x: f"rtrim(regexp_replace(lower(regexp_extract(regexp_replace(trim({x}), '^[a-z]+://', '', 'i'), '^(?:[^/?#@]*@)?([^/?#]*)', 1)), ':[0-9]+$', ''), '.')"
_ROOT = lambda x: f"(CASE WHEN len(string_split({x}, '.')) <= 2 THEN {x} WHEN array_to_string(string_split({x}, '.')[-2:], '.') IN ({', '.join(repr(s) for s in c.COMPOUND_SUFFIXES)}) THEN array_to_string(string_split({x}, '.')[-3:], '.') ELSE array_to_string(string_split({x}, '.')[-2:], '.') END)"
_DOMAIN = lambda x: f"CASE WHEN contains({x}, '@') AND contains(rtrim(string_split(lower(trim({x})), '@')[-1], '.'), '.') THEN rtrim(string_split(lower(trim({x})), '@')[-1], '.') END"
_PUBLIC = ", ".join(repr(p) for p in c.PUBLIC_PROVIDERS)


@query("f01_normalize_name", f"SELECT id, {_NORM('denomination')} AS norm FROM companies", ("companies",))
def normalize(v):
    return v.companies.select("id", t.normalize_name(F.col("denomination")).alias("norm"))


@query("f03_contact_hash", f"SELECT id, sha256({_NORM(chr(40) + 'coalesce(first_name, chr(39)||chr(39))'.replace('chr(39)||chr(39)', repr('')) + ' || ' + repr('_') + ' || last_name)')} || '_' || company_id::VARCHAR) AS contact_hash FROM contacts", ("contacts",))
def contact_hash(v):
    return v.contacts.select("id", c.contact_hash(F.col("first_name"), F.col("last_name"), F.col("company_id")).alias("contact_hash"))


@query("f04_email_fingerprint", "SELECT id, sha256(lower(trim(email))) AS email_hash FROM contacts", ("contacts",))
def email_fingerprint(v):
    return v.contacts.select("id", c.fingerprint(F.col("email")).alias("email_hash"))


@query("f05_person_key")
def person_key(v):
    return v.contacts.select("id", c.person_key(F.col("email"), "pepper").alias("person_key"))


@query("f06_dedup_key", """SELECT id, source || CASE WHEN source IN ('insee', 'bodacc') THEN ':siren:' || coalesce(company_id::VARCHAR, '') WHEN source = 'google-maps' THEN ':query:' || md5(coalesce(company_id::VARCHAR, '') || '|,') WHEN source = 'website' THEN ':url:' || md5(coalesce(payload, '')) END AS dedup_key FROM runs""", ("runs",))
def dedup_key(v):
    nothing = F.lit(None).cast("string")
    who = F.col("company_id")
    return v.runs.select("id", c.dedup_key(F.col("source"), who, who, nothing, nothing, F.col("payload"), F.col("payload")).alias("dedup_key"))


@query("f07_email_domain", f"SELECT id, {_DOMAIN('email')} AS domain FROM contacts", ("contacts",))
def email_domain(v):
    return v.contacts.select("id", c.email_domain(F.col("email")).alias("domain"))


@query("f08_site_host", f"SELECT id, CASE WHEN contains({_HOST('website')}, '.') THEN {_HOST('website')} END AS host FROM companies", ("companies",))
def site_host(v):
    return v.companies.select("id", c.site_host(F.col("website")).alias("host"))


@query("f09_registrable_domain", f"SELECT id, {_ROOT('host')} AS root FROM (SELECT id, {_HOST('website')} AS host FROM companies)", ("companies",))
def registrable(v):
    return v.companies.select("id", c.registrable(c.site_host(F.col("website"))).alias("root"))


@query(
    "f10_email_confidence",
    f"""SELECT id, CASE WHEN domain IS NULL THEN NULL WHEN {_ROOT('domain')} IN ({_PUBLIC}) OR domain IN ({_PUBLIC}) THEN 'C' WHEN {_ROOT('domain')} = {_ROOT('host')} THEN 'A' ELSE 'B' END AS tier
FROM (SELECT t.id, {_DOMAIN('t.email')} AS domain, CASE WHEN contains({_HOST('c.website')}, '.') THEN {_HOST('c.website')} END AS host FROM contacts t LEFT JOIN companies c ON t.company_id = c.id)""",
    ("contacts", "companies"),
)
def email_confidence(v):
    sites = v.companies.select(F.col("id").alias("company_id"), "website")
    return v.contacts.join(sites, "company_id", "left").select("id", c.email_confidence(F.col("email"), F.col("website")).alias("tier"))


@query("f11_aggressive_key", f"SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(lower(translate(coalesce(name, ''), {_ACC})), '\\b(chaine de television|chaine tv|television|radio|tv)\\b', ' ', 'g')), '^(le|la|les|l)\\s+', ''), '[^a-z0-9]', '', 'g') AS norm FROM media", ("media",))
def aggressive(v):
    return v.media.select("id", t.aggressive_key(F.col("name")).alias("norm"))


@query("f12_light_key", f"SELECT id, trim(regexp_replace(lower(translate(coalesce(name, ''), {_ACC})), '\\s+', ' ', 'g')) AS norm, 'arcom:' || media_type || ':' || substr(md5(name), 1, 24) AS stable_id FROM media", ("media",))
def light(v):
    return v.media.select("id", t.light_key(F.col("name")).alias("norm"), F.concat(F.lit("arcom:"), "media_type", F.lit(":"), F.substring(F.md5("name"), 1, 24)).alias("stable_id"))


@query("f13_naf_key", "SELECT id, regexp_replace(upper(coalesce(naf, '')), '[^0-9A-Z]', '', 'g') AS naf_key FROM companies", ("companies",))
def naf(v):
    return v.companies.select("id", t.naf_key(F.col("naf")).alias("naf_key"))


@query("f15_slug", f"SELECT id, substr(regexp_replace(regexp_replace(lower(translate(coalesce(denomination, ''), {_ACC})), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS slug FROM companies", ("companies",))
def slug(v):
    return v.companies.select("id", t.slug(F.col("denomination")).alias("slug"))


@query("f16_extract_emails", f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all(text, '{c.EMAIL}')])), ' ') END AS emails FROM documents")
def emails(v):
    return v.documents.select("doc_id", F.array_join(F.sort_array(c.extract_emails(F.col("text"))), " ").alias("emails"))


@query("f16_extract_phones", f"SELECT doc_id, array_to_string(list_sort(list_distinct([regexp_replace(x, '[\\s.-]', '', 'g') FOR x IN regexp_extract_all(text, '{c.PHONE}')])), ' ') AS phones FROM documents")
def phones(v):
    return v.documents.select("doc_id", F.array_join(F.sort_array(c.extract_phones(F.col("text"))), " ").alias("phones"))


@query("f18_french_phones")
def french_phones(v):
    return v.documents.select("doc_id", F.array_join(F.sort_array(c.french_phones(F.col("text"))), " ").alias("phones"))


@query("f19_html_text", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages")
def html_text(v):
    return v.pages.select("page_id", t.html_text(F.col("html")).alias("body"))


@query(
    "f21_email_verdict",
    f"""SELECT id, CASE WHEN email IS NULL OR NOT regexp_full_match(trim(email), '{c.EMAIL}') THEN 'invalid' WHEN {_DOMAIN('email')} IN ({', '.join(repr(x) for x in c.DISPOSABLE)}) THEN 'disposable'
 WHEN string_split(lower(trim(email)), '@')[1] IN ({', '.join(repr(x) for x in c.ROLE_PREFIXES)}) THEN 'role' WHEN id % 9 = 0 THEN 'invalid' WHEN {_DOMAIN('email')} IN ({_PUBLIC}) THEN 'risky' ELSE 'verified' END AS verdict FROM contacts""",
    ("contacts",),
)
def verdict(v):
    return v.contacts.select("id", c.email_verdict(F.col("email"), F.col("id") % 9 != 0).alias("verdict"))


@query(
    "f23_email_candidates",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0
 THEN 'jean.dupont@site.fr j.dupont@site.fr jeandupont@site.fr jdupont@site.fr jean_dupont@site.fr j_dupont@site.fr jean-dupont@site.fr j-dupont@site.fr jean@site.fr dupont@site.fr dupont.jean@site.fr dupontjean@site.fr dupont.j@site.fr dupontj@site.fr jean.du@site.fr jdup@site.fr contact@site.fr info@site.fr'
 ELSE 'dupont@site.fr contact@site.fr info@site.fr' END AS candidates FROM customer""",
)
def candidates(v):
    """Of a whole name, and of one without a first name."""
    first = F.when(F.col("c_custkey") % 2 == 0, "Jean").otherwise("")
    return v.customer.select(F.col("c_custkey").alias("id"), F.array_join(c.email_candidates(first, F.lit("DUPONT"), F.lit("site.fr")), " ").alias("candidates"))


_COMPANIES = ("SARL Boulangerie du Marché", "Axa", "ABC Énergie Services Plus Conseil", "S.A. de la", "Lumen Fils")


@query(
    "f24_candidate_domains",
    """SELECT c_custkey AS id, CASE c_custkey % 5
 WHEN 0 THEN 'boulangeriemarche.fr boulangerie-marche.fr boulangeriemarche.com boulangerie.fr boulangerie-marche.com boulangeriemarche.net boulangeriemarche.eu boulangerie.com'
 WHEN 1 THEN 'axa.fr axa.com axa.net axa.eu'
 WHEN 2 THEN 'abcenergieservicesplus.fr abc-energie-services-plus.fr abcenergieservicesplus.com abc-energie-services-plus.com abcenergieservicesplus.net abcenergieservicesplus.eu abcenergie.fr abcenergie.com aesp.fr aesp.com'
 WHEN 3 THEN ''
 ELSE 'lumenfils.fr lumen-fils.fr lumenfils.com lumen.fr lumen-fils.com lumenfils.net lumenfils.eu lumen.com' END AS domains FROM customer""",
)
def domains(v):
    """Both passes, over names with stop words, accents, one word, many and none."""
    name = F.element_at(F.array(*map(F.lit, _COMPANIES)), (F.col("c_custkey") % 5).cast("int") + 1)
    return v.customer.select(F.col("c_custkey").alias("id"), F.array_join(t.candidate_domains(name, True), " ").alias("domains"))


@query("f25_verify_page")
def verify(v):
    pages = v.pages.select(F.col("page_id").alias("id"), t.html_text(F.col("html")).alias("body"))
    return v.companies.join(pages, "id").select("id", t.verify_page(F.col("body"), F.col("siren"), F.col("denomination"), F.col("city")).alias("verified"))


@query("f26_canonical_url", f"SELECT id, CASE WHEN lower(website) LIKE 'http://%' THEN 'http' ELSE 'https' END || '://' || regexp_replace({_HOST('website')}, '^www\\.', '') || '/' AS url FROM companies", ("companies",))
def canonical_url(v):
    return v.companies.select("id", c.canonical_url(F.col("website")).alias("url"))


_SECTOR = " ".join(f"WHEN d BETWEEN {a} AND {b} THEN '{n}'" for n, spans in k.SECTORS.items() for a, b in spans)


@query("f29_sector", f"SELECT id, CASE WHEN naf IS NULL THEN NULL {_SECTOR} ELSE 'autre' END AS sector FROM (SELECT id, naf, try_cast(substr(naf, 1, 2) AS INT) AS d FROM companies)", ("companies",))
def sector(v):
    return v.companies.select("id", k.sector(F.col("naf")).alias("sector"))


_DEPT = "CASE WHEN postcode IS NULL THEN NULL WHEN substr(postcode, 1, 2) = '20' THEN CASE WHEN substr(postcode, 3, 1)::INT <= 1 THEN '2A' ELSE '2B' END WHEN substr(postcode, 1, 2) IN ('97', '98') THEN substr(postcode, 1, 3) ELSE substr(postcode, 1, 2) END"


@query("f30_department", f"SELECT id, {_DEPT} AS department, CASE WHEN substr(postcode, 1, 2) = '20' THEN CASE WHEN postcode < '20200' THEN '2A' ELSE '2B' END WHEN substr(postcode, 1, 2) IN ('97', '98') THEN substr(postcode, 1, 3) ELSE substr(postcode, 1, 2) END AS department_importer FROM companies", ("companies",))
def department(v):
    return v.companies.select("id", k.department(F.col("postcode")).alias("department"), k.department_importer(F.col("postcode")).alias("department_importer"))


_REGION = " ".join(f"WHEN d IN ({', '.join(repr(x) for x in keys.split())}) THEN '{r}'" for r, keys in k.REGIONS.items())


@query("f31_region", f"SELECT id, CASE {_REGION} END AS region FROM (SELECT id, {_DEPT} AS d FROM companies)", ("companies",))
def region(v):
    return v.companies.select("id", k.region(k.department(F.col("postcode"))).alias("region"))


_SIZE = " ".join(f"WHEN effectif_range IN ({', '.join(repr(x) for x in keys.split())}) THEN '{n}'" for n, keys in k.SIZES.items())


@query(
    "f32_sizes",
    f"""SELECT id, CASE WHEN effectif_max IS NULL OR effectif_max <= 9 THEN CASE WHEN is_artisan THEN 'artisan' ELSE 'tpe' END WHEN effectif_max <= 19 THEN 'tpe' WHEN effectif_max <= 249 THEN 'pme' WHEN effectif_max <= 4999 THEN 'eti' ELSE 'grande_entreprise' END AS by_staff,
CASE {_SIZE} END AS by_code, coalesce(lower(CASE WHEN size_category IN ('PME', 'ETI', 'GE') THEN size_category END), CASE {_SIZE} END) AS collected FROM companies""",
    ("companies",),
)
def sizes(v):
    return v.companies.select("id", k.size_by_staff(F.col("effectif_min"), F.col("effectif_max"), F.col("is_artisan")).alias("by_staff"), k.size_by_code(F.col("effectif_range")).alias("by_code"), k.size_collected(F.col("size_category"), F.col("effectif_range")).alias("collected"))


@query("f34_media_family", "SELECT id, CASE WHEN naf LIKE '5813%' OR naf LIKE '5814%' THEN 'presse' WHEN naf LIKE '6010%' THEN 'radio' WHEN naf LIKE '6020%' THEN 'tv' WHEN naf LIKE '6391%' THEN 'agence' ELSE 'autre' END AS family FROM media", ("media",))
def family(v):
    return v.media.select("id", k.media_family(F.col("naf")).alias("family"))


@query("f35_periodicity", "SELECT id, CASE WHEN periodicity IS NULL THEN NULL WHEN periodicity = 'Quotidien' THEN 'quotidien' WHEN periodicity = 'hebdomadaire' THEN 'hebdomadaire' WHEN periodicity = 'Mensuelle' THEN 'mensuel' WHEN periodicity = 'Trimestriel' THEN 'trimestriel' ELSE 'autre' END AS period FROM media", ("media",))
def period(v):
    return v.media.select("id", k.periodicity(F.col("periodicity")).alias("period"))


SCORE_SQL = """least(100, CASE WHEN email_generic <> '' THEN 15 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN linkedin_url IS NOT NULL THEN 10 ELSE 0 END
 + CASE WHEN address <> '' THEN 10 ELSE 0 END + CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN enseigne <> '' THEN 5 ELSE 0 END + CASE WHEN recent_signals > 0 THEN 5 ELSE 0 END
 + CASE WHEN c.id IN (SELECT company_id FROM contacts WHERE email_status IN ('valid', 'catchall', 'unknown', 'role')) THEN 20 ELSE 0 END)"""


def scored(v):
    reachable = v.contacts.where(k.contactable(F.col("email_status"))).select(F.col("company_id").alias("_cid")).distinct()
    companies = v.companies.join(reachable, F.col("id") == F.col("_cid"), "left")
    return companies.withColumn("computed", k.quality_score({n: F.col(n) for n in companies.columns}, F.col("_cid").isNotNull()))


@query("f36_quality_score", f"SELECT id, score, CASE WHEN score >= 90 THEN 'complete' WHEN score >= 50 THEN 'partielle' ELSE 'basique' END AS badge FROM (SELECT c.id, {SCORE_SQL} AS score FROM companies c)", ("companies", "contacts"))
def quality(v):
    return scored(v).select("id", F.col("computed").alias("score"), k.quality_badge(F.col("computed")).alias("badge"))


@query("f39_reachability", "SELECT c.id, CASE WHEN coalesce(archive_reason = 'entreprise_radiee', false) THEN 'archived_no_email' WHEN email_generic <> '' OR c.id IN (SELECT company_id FROM contacts WHERE email_status IN ('valid', 'catchall', 'unknown', 'role')) THEN 'ready_for_outreach' ELSE 'archived_no_email' END AS status FROM companies c", ("companies", "contacts"))
def reach(v):
    return scored(v).select("id", k.reachability(F.coalesce(F.col("archive_reason") == "entreprise_radiee", F.lit(False)), F.col("_cid").isNotNull(), F.col("email_generic")).alias("status"))


@query("f40_campaign_progress", "SELECT campaign_id, CAST(round(greatest(least(1.0, done / 500.0), least(1.0, minutes / 100000.0)) * 100) AS INT) AS percent FROM (SELECT campaign_id, count(*)::DOUBLE AS done, floor(sum(greatest(0, latency_ms)) / 60000)::DOUBLE AS minutes FROM runs WHERE status = 'success' GROUP BY campaign_id)", ("runs",))
def progress(v):
    sums = v.runs.where("status = 'success'").groupBy("campaign_id").agg(F.count("*").alias("done"), F.floor(F.sum(F.greatest(F.lit(0), "latency_ms")) / 60000).alias("minutes"))
    return sums.select("campaign_id", k.campaign_percent(F.col("done"), F.lit(500), F.col("minutes"), F.lit(100000)).alias("percent"))


@query("f42_registry_match", f"SELECT id, {_NORM('denomination')} LIKE {_NORM('city')} || '%' AS prefix_match FROM companies", ("companies",))
def registry_match(v):
    return v.companies.select("id", t.normalize_name(F.col("denomination")).startswith(t.normalize_name(F.col("city"))).alias("prefix_match"))


_TITLES = ("Directrice DRH", "CHRO", "CFO groupe", "Directeur financier", "CIO", "Directeur des systèmes d'information", "CMO", "Chief Revenue Officer", "Directeur commercial", "Président", "Managing Director", "Chief Operating Officer", "CTO", "assistante")


@query("f43_position", "SELECT c_custkey AS id, CASE c_custkey % 15 WHEN 0 THEN 'drh' WHEN 1 THEN 'drh' WHEN 2 THEN 'daf' WHEN 3 THEN 'daf' WHEN 4 THEN 'dsi' WHEN 5 THEN 'dsi' WHEN 6 THEN 'cmo' WHEN 7 THEN 'cco' WHEN 8 THEN 'cco' WHEN 9 THEN 'ceo' WHEN 10 THEN 'ceo' WHEN 11 THEN 'coo' ELSE 'other' END AS position FROM customer")
def position(v):
    """Titles of every kind, and none (null), dealt over the customers."""
    title = F.element_at(F.array(*map(F.lit, _TITLES), F.lit(None)), (F.col("c_custkey") % 15).cast("int") + 1)
    return v.customer.select(F.col("c_custkey").alias("id"), t.position(title).alias("position"))


@query("f44_signatures")
def signatures(v):
    signed = v.runs.select("id", "payload", c.hmac_sha256("secret", F.col("payload")).alias("signature"), "started_at")
    late = F.col("started_at") + F.make_dt_interval(secs=(F.col("id") % 600).cast("decimal(18,6)"))
    return signed.select("id", c.signature_ok("secret", F.col("payload"), F.col("signature"), F.col("started_at"), late).alias("accepted"))


_URLS = (
    "https://example.fr/a", "http://0.1.2.3/", "http://10.9.8.7/x", "http://100.64.0.1/", "http://100.128.0.1/", "http://127.9.9.9:8080/", "http://169.254.1.1/", "http://172.31.255.255/", "http://172.32.0.1/", "http://192.0.0.9/",
    "http://192.168.3.4/", "http://198.19.0.1/", "http://224.0.0.1/", "http://250.1.1.1/", "http://8.8.8.8/", "http://metadata.google.internal/", "http://user@localhost:80/", "http://[::1]/", "ftp://example.fr/", "file:///etc/hosts", "http://1.2.3/",
)


@query("f45_url_verdicts", "SELECT c_custkey AS id, CASE WHEN c_custkey % 22 IN (0, 4, 8, 14) THEN 'ok' WHEN c_custkey % 22 IN (15, 16, 17) THEN 'host' WHEN c_custkey % 22 IN (18, 19, 21) THEN 'scheme' ELSE 'address' END AS verdict FROM customer")
def url_verdicts(v):
    """Addresses in each denied network and beside it, denied hosts, other schemes and null, dealt over the customers."""
    url = F.element_at(F.array(*map(F.lit, _URLS), F.lit(None)), (F.col("c_custkey") % 22).cast("int") + 1)
    return v.customer.select(F.col("c_custkey").alias("id"), c.url_verdict(url).alias("verdict"))


_BOXES = ("x@trashmail.com", "noreply@site.fr", "webmaster@site.fr", "Marketing@site.fr", "jean.dupont@gmail.com", "jean.dupont@site.fr", "jean.dupont@nowhere.fr", "no address", "x@deadspam.com", "enquiries@site.fr", "x@disposableinbox.com")


@query("f21_verdict_branches", "SELECT c_custkey AS id, CASE WHEN c_custkey % 12 IN (0, 8, 10) THEN 'disposable' WHEN c_custkey % 12 IN (1, 2, 3, 9) THEN 'role' WHEN c_custkey % 12 = 4 THEN 'risky' WHEN c_custkey % 12 = 5 THEN 'verified' ELSE 'invalid' END AS verdict FROM customer")
def verdict_branches(v):
    """Addresses of every verdict, and null, dealt over the customers."""
    box = F.element_at(F.array(*map(F.lit, _BOXES), F.lit(None)), (F.col("c_custkey") % 12).cast("int") + 1)
    return v.customer.select(F.col("c_custkey").alias("id"), c.email_verdict(box, ~box.endswith("nowhere.fr")).alias("verdict"))


@query("p30_masking", "SELECT id, CASE WHEN email IS NULL THEN NULL ELSE substr(email, 1, 1) || '***@' || string_split(email, '@')[-1] END AS email, CASE WHEN phone IS NULL THEN NULL ELSE substr(phone, 1, 4) || repeat('*', length(phone) - 6) || right(phone, 2) END AS phone FROM contacts", ("contacts",))
def masking(v):
    return v.contacts.select("id", c.mask_email(F.col("email")).alias("email"), c.mask_phone(F.col("phone")).alias("phone"))


@query("p31_duplicate_mask", "SELECT id, substr(email, 1, 1) || '...(' || length(string_split(email, '@')[1])::VARCHAR || ')@' || string_split(email, '@')[-1] AS masked FROM contacts", ("contacts",))
def duplicate_mask(v):
    return v.contacts.select("id", c.mask_duplicate(F.col("email")).alias("masked"))
