"""Classifications of a company: place, size, sector, score and status."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contact import CONTACTABLE
from .text import naf_key, unaccent

#: Departments by region code.
REGIONS = {
    "84": "01 03 07 15 26 38 42 43 63 69 73 74",
    "27": "21 25 39 58 70 71 89 90",
    "53": "22 29 35 56",
    "24": "18 28 36 37 41 45",
    "94": "2A 2B",
    "44": "08 10 51 52 54 55 57 67 68 88",
    "32": "02 59 60 62 80",
    "11": "75 77 78 91 92 93 94 95",
    "28": "14 27 50 61 76",
    "75": "16 17 19 23 24 33 40 47 64 79 86 87",
    "76": "09 11 12 30 31 32 34 46 48 65 66 81 82",
    "52": "44 49 53 72 85",
    "93": "04 05 06 13 83 84",
    "01": "971",
    "02": "972",
    "03": "973",
    "04": "974",
    "06": "976",
}
#: Staff codes by size class.
SIZES = {"micro": "00 01 02 NN", "tpe": "03 11 12", "pme": "21 22 31 32", "eti": "41 42 51", "grande": "52 53"}
#: Activity divisions by sector, as single numbers and ranges.
SECTORS = {
    "it_saas": ((62, 63),), "media_edition": ((58, 60),), "btp": ((41, 43),), "sante": ((86, 88),), "agro_alimentaire": ((10, 12),), "agriculture": ((1, 3),),
    "commerce": ((45, 47),), "hotellerie_restauration": ((55, 56),), "finance_assurance": ((64, 66),), "enseignement": ((85, 85),), "transport": ((49, 53),),
    "services_pro": ((69, 75),), "industrie": ((13, 33),), "energie": ((35, 35),), "environnement": ((36, 39),), "immobilier": ((68, 68),),
    "services_aux_entreprises": ((77, 82),), "administration": ((84, 84),), "arts_culture": ((90, 93),), "associatif": ((94, 95),), "services_perso": ((96, 98),),
}


def lookup(key: Column, groups: dict[str, str]) -> Column:
    """Name of the group that lists a key; null if none does."""
    pairs = [(k, name) for name, keys in groups.items() for k in keys.split()]
    return F.try_element_at(F.create_map(*map(F.lit, chain(*pairs))), key)


def department(postcode: Column) -> Column:
    """Two characters; Corsica by the third digit; three characters overseas."""
    two, third = F.substring(postcode, 1, 2), F.coalesce(F.substring(postcode, 3, 1).try_cast("int"), F.lit(0))
    return F.when(F.length(postcode) >= 2, F.when(two == "20", F.when(third <= 1, "2A").otherwise("2B")).when(two.isin("97", "98"), F.when(F.length(postcode) >= 3, F.substring(postcode, 1, 3))).otherwise(two))


def department_importer(postcode: Column) -> Column:
    """The importers' rule: padded to five digits, Corsica cut at 20200."""
    full = F.lpad(postcode, 5, "0")
    two = F.substring(full, 1, 2)
    return F.when(two == "20", F.when(full < "20200", "2A").otherwise("2B")).when(two.isin("97", "98"), F.substring(full, 1, 3)).otherwise(two)


def region(department_code: Column) -> Column:
    return lookup(department_code, REGIONS)


def commune(insee: Column, ban: Column) -> Column:
    return F.when(F.length(insee) == 5, insee).when(F.length(ban) == 5, ban)


def size_by_staff(low: Column, high: Column, artisan: Column) -> Column:
    """Size by the upper bound of staff."""
    small = F.when(F.coalesce(artisan, F.lit(False)), "artisan").otherwise("tpe")
    return F.when(high.isNull() | (high == 0) | (high <= 9), small).when(high <= 19, "tpe").when(high <= 249, "pme").when(high <= 4999, "eti").otherwise("grande_entreprise")


def size_by_code(code: Column) -> Column:
    """Size by the registry's staff code."""
    return lookup(code, SIZES)


def size_collected(category: Column, code: Column) -> Column:
    """The registry's own category first, then the staff code."""
    return F.coalesce(F.lower(F.when(category.isin("PME", "ETI", "GE"), category)), size_by_code(code))


def sector(naf: Column) -> Column:
    """Sector by the activity's division; autre for an unknown one, null without a code."""
    division = F.substring(naf_key(naf), 1, 2).try_cast("int")
    out = F.lit("autre")
    for name, spans in reversed(SECTORS.items()):
        for low, high in spans:
            out = F.when(division.between(low, high), name).otherwise(out)
    return F.when(F.length(naf) >= 2, out)


def media_family(naf: Column) -> Column:
    """Press, radio, television, online or other by activity prefix."""
    code = naf_key(naf)
    return F.when(code.startswith("5813") | code.startswith("5814"), "presse").when(code.startswith("6010"), "radio").when(code.startswith("6020"), "tv").when(code.startswith("6391"), "agence").otherwise("autre")


def periodicity(label: Column) -> Column:
    """Normal name of a period."""
    x = F.lower(unaccent(label))
    out = F.when(x.isNull(), None)
    for stem, name in (("quotid", "quotidien"), ("hebdo", "hebdomadaire"), ("bimens", "bimensuel"), ("mens", "mensuel"), ("trimes", "trimestriel"), ("annu", "annuel")):
        out = out.when(F.contains(x, F.lit(stem)), name)
    return out.otherwise("autre")


def quality_score(c: dict[str, Column], reachable: Column) -> Column:
    """0 to 100 by what is known: mail 15, site 15, phone 10, profile 10, address 10, place 10, sign 5, signal 5, contact 20."""
    filled = lambda x: x.isNotNull() & (x != "")
    parts = [
        (filled(c["email_generic"]), 15), (c["website"].isNotNull(), 15), (c["phone"].isNotNull(), 10), (c["linkedin_url"].isNotNull(), 10), (filled(c["address"]), 10),
        (c["lat"].isNotNull() & c["lon"].isNotNull(), 10), (filled(c["enseigne"]), 5), (F.coalesce(c["recent_signals"], F.lit(0)) > 0, 5), (F.coalesce(reachable, F.lit(False)), 20),
    ]
    return F.least(F.lit(100), sum((F.when(test, points).otherwise(0) for test, points in parts), F.lit(0)))


def quality_badge(score: Column) -> Column:
    return F.when(score >= 90, "complete").when(score >= 50, "partielle").otherwise("basique")


def reachability(closed: Column, has_contact: Column, generic: Column) -> Column:
    """Status of a company for outreach."""
    reachable = F.coalesce(has_contact, F.lit(False)) | (generic.isNotNull() & (generic != ""))
    return F.when(closed, "archived_no_email").when(reachable, "ready_for_outreach").otherwise("archived_no_email")


def contactable(status: Column) -> Column:
    return F.coalesce(status.isin(*CONTACTABLE), F.lit(False))


def campaign_percent(done: Column, most: Column, minutes: Column, limit: Column) -> Column:
    """Progress: the larger of the shares of companies and of time, in percent."""
    share = lambda a, b: F.when(b > 0, F.least(F.lit(1.0), a / b)).otherwise(0.0)
    return F.round(F.greatest(share(done, most), share(minutes, limit)) * 100).cast("int")


def backoff_minutes(attempts: Column) -> Column:
    return F.least(F.lit(60), F.pow(F.lit(2.0), F.least(attempts, F.lit(6)))).cast("int")
