"""Addresses, sites, phones and their derived values."""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_name

#: Mail providers of the general public.
PUBLIC_PROVIDERS = (
    "gmail.com", "googlemail.com", "outlook.com", "outlook.fr", "hotmail.com", "hotmail.fr", "hotmail.co.uk", "live.com", "live.fr", "msn.com",
    "icloud.com", "me.com", "mac.com", "yahoo.com", "yahoo.fr", "yahoo.co.uk", "ymail.com", "aol.com",
    "orange.fr", "wanadoo.fr", "free.fr", "laposte.net", "sfr.fr", "neuf.fr", "bbox.fr", "numericable.fr", "club-internet.fr", "aliceadsl.fr",
    "gmx.com", "gmx.fr", "gmx.de", "web.de", "t-online.de", "freenet.de", "protonmail.com", "proton.me", "pm.me",
    "mail.com", "mail.ru", "yandex.com", "yandex.ru", "zoho.com", "fastmail.com", "inbox.com", "tutanota.com", "tuta.io",
)
#: Suffixes of two labels.
COMPOUND_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "me.uk", "ltd.uk", "plc.uk", "com.fr", "asso.fr", "gouv.fr", "nom.fr", "prd.fr", "tm.fr",
    "co.jp", "com.au", "co.nz", "com.br", "co.za", "com.es", "com.pt", "com.pl", "com.tr", "com.mx",
)
#: Statuses of an address that can be written to.
CONTACTABLE = ("valid", "catchall", "unknown", "role")
#: Domains of throw-away addresses.
DISPOSABLE = (
    "10minutemail.com", "10minutemail.net", "guerrillamail.com", "guerrillamail.net",
    "mailinator.com", "temp-mail.org", "tempmail.com", "tempmailaddress.com",
    "throwaway.email", "trashmail.com", "yopmail.com", "fakeinbox.com",
    "getnada.com", "maildrop.cc", "mintemail.com", "sharklasers.com",
    "grr.la", "guerrillamailblock.com", "pokemail.net", "spam4.me",
    "mvrht.net", "bccto.me", "bugmenot.com", "getairmail.com",
    "armyspy.com", "cuvox.de", "dayrep.com", "einrot.com",
    "fleckens.hu", "gustr.com", "jourrapide.com", "rhyta.com",
    "superrito.com", "teleworm.us", "33mail.com", "anonbox.net",
    "emailondeck.com", "filzmail.com", "emailsensei.com", "etranquil.com",
    "incognitomail.org", "mailcatch.com", "mailmetrash.com", "mailnesia.com",
    "mailsac.com", "mailtemp.info", "mytrashmail.com", "noclickemail.com",
    "nomail.xl.cx", "pookmail.com", "smoug.net", "sogetthis.com",
    "spambox.us", "spamfree24.org", "spamgourmet.com", "spamhole.com",
    "spamstack.net", "spamthisplease.com", "suremail.info", "tempinbox.com",
    "tempmails.net", "throwawayemailaddress.com", "trashymail.com", "vpn.st",
    "wegwerfmail.de", "wegwerpmailadres.nl", "wh4f.org", "whatpaas.com",
    "banana-mail.com", "banit.club", "beefmilk.com", "binkmail.com",
    "bobmail.info", "bofthew.com", "bootybay.de", "brennendesreich.de",
    "bunsenhoneydew.com", "card.zp.ua", "casualdx.com", "cek.pm",
    "centermail.com", "centermail.net", "choicemail1.com", "clrmail.com",
    "cmail.net", "cmail.org", "coldemail.info", "cool.fr.nf",
    "correo.blogos.net", "cosmorph.com", "courriel.fr.nf", "cubiclink.com",
    "curryworld.de", "cust.in", "dacoolest.com", "dandikmail.com",
    "dawin.com", "dcemail.com", "deadaddress.com", "deadspam.com",
    "delikkt.de", "despam.it", "despammed.com", "devnullmail.com",
    "dfgh.net", "digitalsanctuary.com", "discardmail.com", "discardmail.de",
    "disposableaddress.com", "disposableemailaddresses.com", "disposableinbox.com",
)
#: Local parts that no single person has.
ROLE_PREFIXES = (
    "abuse", "admin", "administrator", "all", "billing", "contact", "help",
    "info", "mail", "marketing", "noreply", "no-reply", "postmaster", "root",
    "sales", "security", "spam", "support", "webmaster", "hostmaster",
    "mailer-daemon", "newsletter", "accounts", "service", "services",
    "team", "office", "hello", "press", "media", "news", "jobs",
    "careers", "hr", "humanresources", "legal", "finance", "accounting",
    "enquiry", "enquiries", "inquiry", "inquiries", "feedback", "complaints",
)
#: Networks and hosts that may not be fetched.
DENIED_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4",
)
DENIED_HOSTS = ("169.254.169.254", "metadata.google.internal", "100.100.100.200", "metadata.azure.com", "localhost", "127.0.0.1", "::1", "0.0.0.0")
#: Forms of a person's address; f, last2 and last3 are the first letters of the names.
EMAIL_PATTERNS = (
    "{first}.{last}", "{f}.{last}", "{first}{last}", "{f}{last}", "{first}_{last}", "{f}_{last}", "{first}-{last}", "{f}-{last}", "{first}", "{last}",
    "{last}.{first}", "{last}{first}", "{last}.{f}", "{last}{f}", "{first}.{last2}", "{f}{last3}", "contact", "info",
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?33|0)[\s.-]?[1-9](?:[\s.-]?[0-9]{2}){4}"


def email_domain(email: Column) -> Column:
    """What follows the last @, lower case; null without one or without a dot."""
    domain = F.rtrim(F.trim(F.substring_index(F.lower(F.trim(email)), "@", -1)), F.lit("."))
    return F.when(F.contains(email, F.lit("@")) & F.contains(domain, F.lit(".")), domain)


def registrable(host: Column) -> Column:
    """The last two labels, or three where those are a compound suffix."""
    labels = F.split(F.ltrim(host, F.lit(".")), r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(n <= 2, F.array_join(labels, ".")).when(two.isin(*COMPOUND_SUFFIXES), three).otherwise(two)


def site_host(website: Column) -> Column:
    """Host of a URL or bare domain, lower case, without port; null if there is no dot."""
    bare = F.regexp_replace(F.trim(website), r"(?i)^[a-z]+://", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.rtrim(F.regexp_replace(host, r":[0-9]+$", ""), F.lit("."))
    return F.when(F.contains(host, F.lit(".")), host)


def email_confidence(email: Column, website: Column) -> Column:
    """C: public provider; A: the site's own domain; B: another; null: no domain."""
    domain = email_domain(email)
    root = registrable(domain)
    public = root.isin(*PUBLIC_PROVIDERS) | domain.isin(*PUBLIC_PROVIDERS)
    return F.when(domain.isNotNull(), F.when(public, "C").when(root == registrable(site_host(website)), "A").otherwise("B"))


def canonical_url(website: Column) -> Column:
    scheme = F.when(F.lower(website).startswith("http://"), "http").otherwise("https")
    return F.concat(scheme, F.lit("://"), F.regexp_replace(site_host(website), r"^www\.", ""), F.lit("/"))


def fingerprint(email: Column) -> Column:
    """SHA-256 of the trimmed lower-case address."""
    return F.sha2(F.lower(F.trim(email)), 256)


def contact_hash(first: Column, last: Column, company_id: Column) -> Column:
    name = F.concat(F.coalesce(first, F.lit("")), F.lit("_"), F.coalesce(last, F.lit("")))
    return F.sha2(F.concat(normalize_name(name), F.lit("_"), company_id.cast("string")), 256)


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC by its definition over sha2; the pads are made once from the key."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pads = [bytes(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C)]
    inner = F.sha2(F.concat(F.lit(bytearray(pads[0])), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(pads[1])), F.unhex(inner)), 256)


def person_key(email: Column, secret: str, domain: str = "person") -> Column:
    clean = F.lower(F.trim(email))
    return F.when(F.length(clean) > 0, hmac_sha256(secret, F.concat(F.lit(f"{domain}:"), clean)))


def signature_ok(secret: str, body: Column, signature: Column, sent: Column, now: Column, window: int = 300) -> Column:
    """Whether a message's HMAC is right and its time within the window of seconds."""
    fresh = F.abs(F.unix_timestamp(now) - F.unix_timestamp(sent)) <= window
    return F.coalesce((hmac_sha256(secret, body) == signature) & fresh, F.lit(False))


def dedup_key(source: Column, siren: Column, query: Column, lat: Column, lon: Column, url: Column, context: Column) -> Column:
    """Key of a scrape by its source's family, 255 characters at most."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    by_number = ("insee", "annuaire-entreprises", "bodacc", "societe-com", "infogreffe", "france-travail", "crunchbase")
    key = (
        F.when(source.isin(*by_number), F.concat(source, F.lit(":siren:"), text(siren)))
        .when(source == "google-maps", F.concat(source, F.lit(":query:"), F.md5(F.concat(text(query), F.lit("|"), text(lat), F.lit(","), text(lon)))))
        .when(source.isin("pages-jaunes", "website"), F.concat(source, F.lit(":url:"), F.md5(text(url))))
        .when(source.isin("google-search", "direction-finder"), F.concat(source, F.lit(":query:"), F.md5(text(query))))
        .otherwise(F.concat(source, F.lit(":"), F.md5(context)))
    )
    return F.substring(key, 1, 255)


def extract_emails(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), 1), F.lower))


def extract_phones(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({PHONE})"), 1), lambda p: F.regexp_replace(p, r"[\s.-]", "")))


def french_phones(text: Column) -> Column:
    """Phones with the country prefix written as 0."""
    return F.array_distinct(F.transform(extract_phones(text), lambda p: F.regexp_replace(p, r"^\+?33", "0")))


def email_verdict(email: Column, has_mx: Column) -> Column:
    """Syntax, throw-away domain, shared mailbox, mail host, public provider, in that order."""
    domain, local = email_domain(email), F.substring_index(F.lower(F.trim(email)), "@", 1)
    return (
        F.when(~F.coalesce(F.trim(email).rlike(f"^{EMAIL}$"), F.lit(False)), "invalid")
        .when(domain.isin(*DISPOSABLE), "disposable")
        .when(local.isin(*ROLE_PREFIXES), "role")
        .when(~F.coalesce(has_mx, F.lit(False)), "invalid")
        .when(domain.isin(*PUBLIC_PROVIDERS), "risky")
        .otherwise("verified")
    )


def email_candidates(first: Column, last: Column, domain: Column) -> Column:
    """Addresses that a person may have at a domain, by EMAIL_PATTERNS; forms of a missing name are left out."""
    f, n = (F.regexp_replace(normalize_name(x), "[^a-z]", "") for x in (first, last))
    names = {"first": f, "last": n, "f": F.substring(f, 1, 1), "last2": F.substring(n, 1, 2), "last3": F.substring(n, 1, 3)}
    forms = []
    for pattern in EMAIL_PATTERNS:
        parts = [x for x in re.split(r"(\{\w+\})", pattern) if x]
        whole = F.concat(*[names[x[1:-1]] if x[0] == "{" else F.lit(x) for x in parts])
        asked = [names[x[1:-1]] for x in parts if x[0] == "{"]
        forms.append(F.when(reduce(and_, [F.length(c) > 0 for c in asked], F.lit(True)), whole))
    return F.array_distinct(F.transform(F.filter(F.array(*forms), lambda x: x.isNotNull()), lambda x: F.concat(x, F.lit("@"), domain)))


def mask_email(email: Column) -> Column:
    """a***@domain; *** where there is no local part."""
    at = F.length(email) - F.length(F.substring_index(email, "@", -1)) - 1
    masked = F.concat(F.substring(email, 1, 1), F.lit("***@"), F.substring_index(email, "@", -1))
    return F.when(email.isNull() | (F.trim(email) == ""), email).when((at <= 0) | ~F.contains(email, F.lit("@")), "***").otherwise(masked)


def mask_phone(phone: Column) -> Column:
    """The first four and last two characters; stars for all of a short one."""
    n = F.length(phone)
    return F.when(phone.isNull() | (F.trim(phone) == ""), phone).when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(phone, 1, 4), F.repeat(F.lit("*"), n - 6), F.substring(phone, -2, 2)))


def mask_duplicate(email: Column) -> Column:
    """x...(n)@domain."""
    local = F.substring_index(email, "@", 1)
    return F.concat(F.substring(local, 1, 1), F.lit("...("), F.length(local).cast("string"), F.lit(")@"), F.substring_index(email, "@", -1))


def mask_ip(ip: Column) -> Column:
    """The network of an address: /24 for version 4, /48 for version 6."""
    return F.when(F.contains(ip, F.lit(".")), F.regexp_replace(ip, r"[0-9]+$", "0")).when(F.contains(ip, F.lit(":")), F.concat(F.array_join(F.slice(F.split(ip, ":"), 1, 3), ":"), F.lit("::")))


def ip_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))


def ip_denied(ip: Column, networks: tuple[str, ...] = DENIED_NETWORKS) -> Column:
    """Whether an address lies in one of some networks."""
    out = F.lit(False)
    for net in networks:
        base, bits = net.split("/")
        size = 2 ** (32 - int(bits))
        low = sum(int(x) * 256 ** (3 - i) for i, x in enumerate(base.split(".")))
        out = out | ip_number(ip).between(low, low + size - 1)
    return F.coalesce(out, F.lit(True))


def url_verdict(url: Column) -> Column:
    """ok, or why a URL may not be fetched: scheme, host, or address (of a denied network)."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    return (
        F.when(~F.coalesce(url.rlike(r"(?i)^https?://"), F.lit(False)), "scheme")
        .when((bare == "") | bare.isin(*DENIED_HOSTS), "host")
        .when(bare.rlike(r"^[0-9.]+$") & ip_denied(bare), "address")
        .otherwise("ok")
    )
