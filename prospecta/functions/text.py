"""Names and free text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they lose their accents to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: The French articles that names are compared without.
ARTICLES = ("de", "du", "la", "le", "les", "d", "l")
#: Titles by what is found first in a position.
POSITIONS = (
    ("drh", "drh|chro|ressources humaines|human resources|chief human"),
    ("daf", "daf|cfo|financier|finance|chief financial"),
    ("dsi", "dsi|cio|systèmes? d.?information|information systems?|chief information"),
    ("cmo", "cmo|marketing|chief marketing"),
    ("cco", "cco|commercial|chief commercial|chief sales|chief revenue|cro"),
    ("ceo", "ceo|directeur général|président|chief executive|managing director"),
    ("coo", "coo|chief operating|directeur des opérations"),
)
#: Words of a company's name that are not looked for in a domain.
STOP_WORDS = ("sarl", "sas", "sasu", "sa", "eurl", "snc", "sci", "sarlu", "scop", "earl", "gie", "sccv", "et", "de", "du", "des", "la", "le", "les", "l", "d")


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalize_name(c: Column) -> Column:
    """Spaces collapsed, French articles dropped, accents off, lower case; null gives ''."""
    collapsed = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    # explicit borders: what \b takes for a word differs between Java versions
    return F.lower(unaccent(F.regexp_replace(collapsed, rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(ARTICLES)})\s+", "")))


def aggressive_key(c: Column) -> Column:
    """For programmes and channels: kind words and a leading article dropped, letters and digits only."""
    base = F.lower(unaccent(F.coalesce(c, F.lit(""))))
    base = F.regexp_replace(base, r"\b(chaine de television|chaine tv|television|radio|tv)\b", " ")
    base = F.regexp_replace(F.trim(base), r"^(le|la|les|l)\s+", "")
    return F.regexp_replace(base, "[^a-z0-9]", "")


def light_key(c: Column) -> Column:
    """Lower case, accents off, single spaces."""
    return F.trim(F.regexp_replace(F.lower(unaccent(F.coalesce(c, F.lit("")))), r"\s+", " "))


def slug(c: Column, most: int = 60) -> Column:
    base = F.regexp_replace(F.lower(unaccent(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(base, "^-|-$", ""), 1, most)


def naf_key(c: Column) -> Column:
    """Upper-case letters and digits of an activity code."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^0-9A-Z]", "")


def like_escape(c: Column) -> Column:
    """A term with the wildcards of LIKE made literal."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def position(c: Column) -> Column:
    """Normalised C-level title, the first that is found; else other."""
    out = F.lit("other")
    for name, pattern in reversed(POSITIONS):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


def html_text(c: Column) -> Column:
    """Visible text of a page: scripts, styles and tags dropped, spaces collapsed."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))


def name_tokens(c: Column, most: int = 4) -> Column:
    """Up to ``most`` words of a name, without accents, of two letters or more, that are no STOP_WORDS."""
    words = F.split(F.regexp_replace(F.lower(unaccent(F.lower(c))), "[^a-z0-9]+", " "), " ")
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS)), 1, most)


def candidate_domains(c: Column, extended: bool = False) -> Column:
    """Domains that a company of this name may have, the likeliest first; ``extended`` adds those of a second pass."""
    t = name_tokens(c)
    n, word = F.size(t), lambda i: F.get(t, F.lit(i))
    joined, hyphened = F.array_join(t, ""), F.array_join(t, "-")
    initials = F.array_join(F.transform(t, lambda w: F.substring(w, 1, 1)), "")
    alone = (n > 1) & (F.length(word(0)) >= 4)
    two = F.concat(word(0), word(1))
    forms = [(n > 0, joined, ".fr"), (n > 1, hyphened, ".fr"), (n > 0, joined, ".com"), (alone, word(0), ".fr")]
    if extended:
        forms += [(n > 1, hyphened, ".com"), (n > 0, joined, ".net"), (n > 0, joined, ".eu"), (alone, word(0), ".com"), (n > 1, two, ".fr"), (n > 1, two, ".com"), (n > 2, initials, ".fr"), (n > 2, initials, ".com")]
    found = F.array(*[F.when(test, F.concat(body, F.lit(end))) for test, body, end in forms])
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull() & (F.length(d) >= 5)))


def verify_page(body: Column, siren: Column, name: Column, city: Column) -> Column:
    """Whether a page is the company's: its number, two words of its name, or one word and its city."""
    text = F.lower(unaccent(F.coalesce(body, F.lit(""))))
    hits = F.size(F.filter(name_tokens(name), lambda w: F.contains(text, w)))
    here = F.coalesce(F.contains(text, F.lower(unaccent(city))), F.lit(False))
    return F.coalesce(F.contains(F.regexp_replace(text, r"\s", ""), siren), F.lit(False)) | (hits >= 2) | ((hits >= 1) & here)


#: The longest outside text that goes into a prompt.
PROMPT_LIMIT = 8000


def scrub_prompt(c: Column) -> Column:
    """Outside text with instructions to a model redacted, backticks as quotes, cut after 8000 characters."""
    c = F.regexp_replace(c, r"(?i)ignore (?:all|the|previous|prior).*?(?:instructions|rules|prompts)", "[redacted]")
    c = F.regexp_replace(c, r"(?i)(?:act as|you are now)\s+(?:a\s+)?(?:different|new|root)", "[redacted]")
    c = F.translate(c, "`", "'")
    return F.when(F.length(c) > PROMPT_LIMIT, F.concat(F.substring(c, 1, PROMPT_LIMIT), F.lit("…"))).otherwise(c)


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """``{{ name }}``, blanks or not, replaced by values; a null or unknown name gives ''. Values named ext_... are scrubbed.

    The template is cut at its names first, so a name within a value stays as it is.
    """
    values = {n: scrub_prompt(v.cast("string")) if n.startswith("ext_") else v.cast("string") for n, v in values.items()}
    name = r"\{\{\s*([a-zA-Z0-9_]+)\s*\}\}"
    between, asked = F.split(template, name), F.regexp_extract_all(template, F.lit(name), 1)
    known = F.map_from_arrays(F.array(*[F.lit(n) for n in values]), F.array(*values.values())) if values else F.create_map().cast("map<string,string>")
    filled = F.transform(asked, lambda n: F.coalesce(F.try_element_at(known, n), F.lit("")))
    return F.concat(F.array_join(F.transform(filled, lambda v, i: F.concat(F.get(between, i), v)), ""), F.element_at(between, -1))
