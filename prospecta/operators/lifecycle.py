"""Records that move: classified site events, the outbox, checked writes, ended programmes, harvested addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contact, text
from ..functions.classify import backoff_minutes

#: What a form asks for, as a relation; other forms come from prospects.
FORM_RELATIONS = {"partenariat": "partenaire", "presse": "presse_media", "investisseur": "investisseur", "speaker": "conference"}
#: Forms that ask for something concrete.
CONCRETE_FORMS = ("audit", "devis", "implementation", "formation", "un_a_un")
#: Services that a form names.
FORM_SERVICES = {"audit": "svc:audit", "formation": "svc:formation", "implementation": "svc:implementation", "speaker": "svc:conference"}
NEWSLETTER = ("newsletter_optin", "newsletter_optout")
MEETINGS = ("calendly_booked", "calendly_completed", "calendly_canceled", "calendly_no_show")
#: What the outbox takes.
OUTBOX_TYPES = ("consent_optout", "consent_optin", "erasure")
OUTBOX_SCOPES = ("business", "vivier")
#: Answers of a site that is away for a while, which use up no attempt (0: no connection).
AWAY = (0, 408, 429, 502, 503, 504)
#: Words at the end of a registered name that don't belong to it.
NAME_ENDS = (
    "SRL", "SA", "SAS", "SASU", "SE", "IFN", "SCA", "ROMANIA", "ROUMANIE", "RO", "BUCURESTI", "BUCAREST", "BUCHAREST",
    "TIMISOARA", "SUCURSALA", "REPREZENTANTA", "FILIALA", "EASTERN", "EUROPE", "EAST", "LYON", "PARIS",
)
#: Mailboxes of an editorial office, best first.
OFFICE_BOXES = ("redaction", "redac", "presse", "contact", "info", "journal")
#: Patterns of addresses that belong to a tool, a parked domain or an example.
PARASITES = (
    r"[0-9a-f]{16,}@", r"@[0-9a-f]{16,}", r"wixpress|sentry", r"scaled_jpg|@2x", r"\.(png|jpe?g|gif|svg|webp|avif)(@|$)",
    r"@(solidnames|sedoparking|parkingcrew|bodis|above\.com|dan\.com|domainmarket|hugedomains|afternic|sedo\.com|godaddy|namecheap)\b",
    r"unitedthemes|readymag|myshopify|squarespace|webflow|weebly|jimdo|wixsite|websitebuilder|wordpress\.com|hostinger|wpengine|kinsta|shopify|webador|monsite",
    r"^(your|votre|user|utilisateur|test|nom|prenom|email|exemple|example)@", r"@(email\.com|domain\.com|domaine\.|exemple\.|example\.|mail\.com|societe\.|votresite\.)",
)


def _chosen(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def event_relation(kind: Column, form: Column) -> Column:
    """Relation that a site event shows."""
    return (
        F.when(kind.isin(*NEWSLETTER), "newsletter")
        .when(kind == "review_posted", "client")
        .when(kind == "form_submission", F.coalesce(_chosen(form, FORM_RELATIONS), F.lit("prospect")))
        .otherwise("prospect")
    )


def event_stage(kind: Column, form: Column) -> Column:
    """Stage of the life cycle that a site event aims at."""
    asked = kind.isin("calendly_booked", "calendly_completed") | ((kind == "form_submission") & form.isin(*CONCRETE_FORMS))
    return F.when(kind == "review_posted", "client").when(asked, "opportunite").otherwise("qualifie")


def event_basis(kind: Column) -> Column:
    """Legal basis: consent for newsletters, else what precedes a contract."""
    return F.when(kind.isin(*NEWSLETTER), "consent").otherwise("precontractual")


def event_tags(kind: Column, form: Column, source: Column, offer: Column, sent: Column) -> Column:
    """Tags of provenance, service and offer, then those sent, each once."""
    provenance = (
        F.when(source.isNotNull(), F.concat(F.lit("src:"), source))
        .when(kind == "form_submission", F.concat(F.lit("src:site-formulaire-"), F.translate(F.coalesce(form, F.lit("")), "_", "-")))
        .when(kind.isin(*MEETINGS), "src:calendly")
        .when(kind.isin(*NEWSLETTER), "src:newsletter")
        .when(kind == "review_posted", "src:avis-client")
        .otherwise("src:site-formulaire-autre")
    )
    derived = F.filter(F.array(provenance, _chosen(form, FORM_SERVICES), F.concat(F.lit("cand-offre:"), offer)), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(derived, F.coalesce(sent, F.array().cast("array<string>"))))


def enqueue(outbox: DataFrame, requests: DataFrame, order: str) -> DataFrame:
    """Requests that enter the outbox: known type and scope, our own origin, a hash, and nothing alike still waiting.

    Of like requests in one batch the first by ``order`` enters.  One already sent may be asked for again.
    """
    same = ["event_type", "email_hash", "scope"]
    wanted = requests.withColumn("email_hash", F.trim("email_hash")).where(
        (F.col("origin") == "crm") & F.col("event_type").isin(*OUTBOX_TYPES) & F.col("scope").isin(*OUTBOX_SCOPES) & (F.col("email_hash") != "")
    )
    waiting = outbox.where(F.col("status").isin("pending", "failed")).select(*same).distinct()
    first = Window.partitionBy(*same).orderBy(order)
    return wanted.join(waiting, same, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def after_reply(code: Column, attempts: Column, now: Column, most: int = 8) -> Column:
    """status, attempts and next_attempt_at of an outbox row after an HTTP answer (0: no connection).

    A refusal (422) is final; a site that is away costs no attempt; any other failure costs one, and the last ends it.
    """
    away, used = code.isin(*AWAY), attempts + 1
    status = F.when(code.between(200, 299), "sent").when(code == 422, "gave_up").when(away, "deferred").when(used >= most, "gave_up").otherwise("failed")
    tried = F.when(away, attempts).otherwise(used)
    later = now + F.make_dt_interval(mins=backoff_minutes(tried))
    return F.struct(status.alias("status"), tried.alias("attempts"), F.when(status.isin("deferred", "failed"), later).alias("next_attempt_at"))


def version_token(*columns: str) -> Column:
    """First half of the SHA-256 of a row's columns as JSON, by name; nulls count."""
    row = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(row, 256), 1, 32)


def stale(sent: Column, current: Column) -> Column:
    """Whether a write must be refused: a list of tokens was sent and the current one isn't among them; * goes through."""
    tokens = F.transform(F.split(sent, ","), lambda t: F.trim(F.translate(F.trim(t), '"', "")))
    asked = F.trim(F.coalesce(sent, F.lit("")))
    return ~((asked == "") | (asked == "*") | F.coalesce(F.array_contains(tokens, current), F.lit(False)))


def mark_ended(media: DataFrame, ends: DataFrame, now: str) -> DataFrame:
    """Media with ``ended_at`` in their JSON of ``socials``: the latest end date of ``ends(qid, ended_on)``; none takes the key away.

    Rows without a Wikidata id of the form Q123 come out unchanged; the other keys stay as they are.
    """
    known = F.from_json("socials", "map<string,variant>")  # variants, so that nested values stay as they are
    word = lambda x: x.cast("string").cast("variant")
    found = ends.where("ended_on IS NOT NULL").groupBy("qid").agg(F.max("ended_on").alias("_end"))
    rows = media.withColumn("_map", known).withColumn("qid", F.regexp_extract(F.get_json_object("socials", "$.wikidata_id"), "^Q[0-9]+$", 0)).withColumn("qid", F.when(F.col("qid") != "", F.col("qid")))
    kept = F.map_filter("_map", lambda k, _: ~k.isin("ended_at", "wikidata_status_checked_at"))
    ended = F.when(F.col("_end").isNotNull(), F.create_map(F.lit("ended_at"), word(F.col("_end")))).otherwise(F.map_filter("_map", lambda k, _: F.lit(False)))
    marked = F.to_json(F.map_concat(kept, ended, F.create_map(F.lit("wikidata_status_checked_at"), word(F.lit(now)))))
    return rows.join(found, "qid", "left").withColumn("socials", F.when(F.col("qid").isNotNull(), marked).otherwise(F.col("socials"))).drop("qid", "_map", "_end")


def parasite(email: Column) -> Column:
    """Whether an address belongs to a tool, a parked domain or an example."""
    return F.coalesce(email.rlike("(?i)" + "|".join(f"(?:{p})" for p in PARASITES)), F.lit(False))


def office_email(emails: Column, website: Column) -> Column:
    """The best harvested address: no parasite, the site's own domain if there is one, then the office's boxes, then the order."""
    good = F.array_distinct(F.filter(emails, lambda e: e.isNotNull() & ~parasite(e)))
    own = F.filter(good, lambda e: F.coalesce(contact.email_confidence(e, website) == "A", F.lit(False)))
    pool = F.when(F.size(own) > 0, own).otherwise(good)
    box = lambda e: F.coalesce(*[F.when(F.contains(F.lower(F.substring_index(e, "@", 1)), F.lit(b)), F.lit(i)) for i, b in enumerate(OFFICE_BOXES)], F.lit(len(OFFICE_BOXES)))
    return F.try_element_at(F.array_sort(F.transform(pool, lambda e, i: F.struct(box(e).alias("box"), i.alias("i"), e.alias("e")))), F.lit(1))["e"]


def _registry_name(name: Column) -> Column:
    plain = F.regexp_replace(F.upper(text.unaccent(name)), r"[^A-Z0-9&' -]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def registry_base(name: Column) -> Column:
    """A registered name without legal forms, places, single letters and dashes at its end; the first word always stays."""
    ends = "|".join(NAME_ENDS)
    return F.rtrim(F.regexp_replace(_registry_name(name), rf"(?: (?:{ends}|[A-Z]|-))+$", ""), F.lit(" -"))


def registry_match(base: Column, found: Column) -> Column:
    """Whether a found name may be the same: equal, one begins with the words of the other, or equal without marks."""
    a, b = _registry_name(found), _registry_name(base)
    bare = lambda x: F.regexp_replace(x, "[' -]", "")
    return (a == b) | F.startswith(a, F.concat(b, F.lit(" "))) | F.startswith(b, F.concat(a, F.lit(" "))) | (bare(a) == bare(b))


def diffusion_zone(kind: Column, category: Column) -> Column:
    """Area that a radio of a category reaches; other media have none."""
    letter = F.upper(F.trim(category))
    return F.when(kind == "radio", F.when(letter.isin("A", "B"), "local").when(letter == "C", "régional").when(letter.isin("D", "E"), "national"))


def broadcast_kind(nature: Column) -> Column:
    """radio or tv by the nature that a register gives."""
    n = F.lower(F.trim(nature))
    return F.when(n == "radio", "radio").when((n == "tv") | n.startswith("tele") | n.startswith("télé"), "tv")
