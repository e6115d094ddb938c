"""Addresses found on pages: which are usable, and whose box each is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of technical boxes that are never taken.
TECHNICAL = ("no-reply@", "noreply@", "postmaster@", "abuse@", "webmaster@")
#: Endings that are file types, not domains.
FALSE_ENDINGS = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "ico", "css", "js",
    "json", "xml", "map", "woff", "woff2", "ttf", "eot", "mp4", "webm", "pdf", "zip",
)
#: Roles of service boxes by words of the local part, the first role with a word counts;
#: a word of four letters or more counts anywhere in it, a shorter one only alone.
SERVICE_ROLES = {
    "Commercial": ("commercial", "commerciale", "sales", "vente", "ventes", "devis"),
    "Comptabilité": ("compta", "comptabilite", "facturation", "facture", "billing", "finance", "finances"),
    "Ressources humaines": ("rh", "recrut", "recrutement", "emploi", "job", "jobs", "career", "careers", "candidature"),
    "Direction": ("direction", "ceo", "gerance", "gerant", "pdg", "dg", "president", "presidente"),
    "Support / SAV": ("sav", "support", "aide", "help", "assistance", "serviceclient", "service-client"),
    "Communication / Presse": ("presse", "press", "media", "medias", "communication", "comm"),
    "Marketing": ("marketing", "mkt", "digital"),
    "Achats": ("achat", "achats", "purchasing", "procurement", "fournisseur", "fournisseurs"),
    "Contact général": ("contact", "info", "infos", "information", "accueil", "hello", "bonjour", "welcome", "mail", "societe"),
}
#: Parts of consumer providers' domains.
CONSUMER_DOMAINS = (
    "gmail.", "orange.fr", "free.fr", "wanadoo.fr", "hotmail.", "outlook.",
    "live.", "yahoo.", "laposte.net", "sfr.fr", "gmx.", "icloud.com",
    "protonmail.", "proton.me", "aol.", "bbox.fr", "neuf.fr",
)
_ANY = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"


def usable_emails(text: Column) -> Column:
    """Addresses of a page in order, lower case, each once: no technical box, no image or asset name, none that isn't well formed."""

    def real(e: Column) -> Column:
        formed = ~e.rlike(r"^\.|\.@|\.\.|@[.-]|-\.|\.-|^.{65,}@")
        technical = e.rlike("^(" + "|".join(p.replace("-", r"\-") for p in TECHNICAL) + ")")
        return formed & ~technical & ~e.rlike(r"@\d+x\.") & ~F.substring_index(e, ".", -1).isin(*FALSE_ENDINGS)

    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_ANY), 0), F.lower)), real)


def service_role(local: Column) -> Column:
    """The role of a service box by its local part; null if it has no such word."""
    role = F.lit(None).cast("string")
    for label, words in reversed(SERVICE_ROLES.items()):
        within = [w for w in words if len(w) >= 4]
        role = F.when(local.isin(*words) | local.rlike("|".join(within)), label).otherwise(role)
    return role


def _upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def classify_email(email: Column, executives: Column) -> Column:
    """Whose box an address is: struct of first_name, last_name, role and kind (dirigeant, service, person).

    ``executives`` is an array of structs (first_name, last_name, role): the first whose last or first name, of three letters or
    more, stands in the local part has it.  Then service boxes by role, then first.last names; the rest are services.
    """
    local = F.lower(F.substring_index(email, "@", 1))
    named = lambda n: (F.length(n) >= 3) & F.contains(local, F.lower(n))
    boss = F.try_element_at(F.filter(executives, lambda x: F.coalesce(named(x["last_name"]), F.lit(False)) | F.coalesce(named(x["first_name"]), F.lit(False))), F.lit(1))
    role, person = service_role(local), r"^([a-zà-ÿ]+)[._-]([a-zà-ÿ]{2,})$"
    kind = lambda first, last, role, kind: F.struct(first.alias("first_name"), last.alias("last_name"), role.alias("role"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("string")
    return (
        F.when(boss.isNotNull(), kind(boss["first_name"], F.coalesce(boss["last_name"], F.lit("Dirigeant")), F.coalesce(boss["role"], F.lit("dirigeant")), "dirigeant"))
        .when(role.isNotNull(), kind(none, _upper_first(local), role, "service"))
        .when(local.rlike(person), kind(_upper_first(F.regexp_extract(local, person, 1)), _upper_first(F.regexp_extract(local, person, 2)), F.lit("à qualifier"), "person"))
        .otherwise(kind(none, _upper_first(local), F.lit("Service"), "service")))


def consumer(email: Column) -> Column:
    """Whether an address is one of a consumer provider."""
    domain = F.lower(F.substring_index(email, "@", -1))
    return F.contains(email, F.lit("@")) & F.exists(F.array(*map(F.lit, CONSUMER_DOMAINS)), lambda c: F.contains(domain, c))
