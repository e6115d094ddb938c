"""Joins, gates, links and lists between the relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contact import fingerprint
from ..functions.text import aggressive_key, normalize_name


def not_opposed(rows: DataFrame, opposed: DataFrame, email: str = "email", scope: str | None = "business") -> DataFrame:
    """Rows whose address is in no opposition list of the scope."""
    listed = (opposed.where(F.col("scope") == scope) if scope else opposed).select(fingerprint(F.col("email")).alias("_print")).distinct()
    return rows.join(listed, fingerprint(rows[email]) == listed["_print"], "left_anti")


def campaign_eligible(companies: DataFrame, opposed: DataFrame, tiers: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """Companies that a campaign may write to: an address, not deleted, a tier, no opposition."""
    filled = F.col("email_generic").isNotNull() & (F.col("email_generic") != "")
    return not_opposed(companies.where(filled & F.col("deleted_on").isNull() & F.col("best_email_confidence").isin(*tiers)), opposed, "email_generic")


def list_filters(df: DataFrame, filters: dict[str, str], alias: dict[str, str] | None = None) -> DataFrame:
    """Exact filters of a list view; a comma makes a list of values."""
    for field, value in filters.items():
        df = df.where(F.col((alias or {}).get(field, field)).cast("string").isin(value.split(",")))
    return df


def day_bounds(df: DataFrame, column: str, low: str | None, high: str | None) -> DataFrame:
    """From the start of one day to the end of another; a date that can't be read asks for nothing."""
    for text, test in ((low, lambda c, d: c >= d), (high, lambda c, d: c <= d)):
        if text is not None:
            day = F.lit(text).try_cast("date")
            df = df.where(day.isNull() | test(F.col(column).cast("date"), day))
    return df


def with_all_tags(companies: DataFrame, company_tag: DataFrame, slugs: list[str]) -> DataFrame:
    """Companies that bear every one of some tags."""
    bearers = company_tag.where(F.col("slug").isin(slugs)).groupBy("company_id").agg(F.count_distinct("slug").alias("n")).where(F.col("n") == len(set(slugs)))
    return companies.join(bearers, companies["id"] == bearers["company_id"], "left_semi")


def name_contains(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows whose normal name contains one of some terms, taken literally."""
    test = F.lit(False)
    for term in terms:
        test = test | F.contains(normalize_name(F.col(column)), normalize_name(F.lit(term)))
    return df.where(test)


def hub_search(companies: DataFrame, contacts: DataFrame, term: str) -> DataFrame:
    """By name, by number prefix (3 to 9 digits), or by a contact's name or address prefix."""
    low = term.lower()
    people = contacts.where(F.lower("last_name").startswith(low) | F.lower("email").startswith(low)).select(F.col("company_id").alias("_cid")).distinct()
    flagged = companies.join(people, companies["id"] == people["_cid"], "left")
    test = F.contains(normalize_name(F.col("denomination")), normalize_name(F.lit(term))) | F.col("_cid").isNotNull()
    if term.isdigit() and 3 <= len(term) <= 9:
        test = test | F.coalesce(F.col("siren").startswith(term), F.lit(False))
    return flagged.where(test).drop("_cid")


def temperature(companies: DataFrame, company_tag: DataFrame, view: str) -> DataFrame:
    """actifs: past the first stage or tagged by hand; froids: the others; tous: all."""
    if view == "tous":
        return companies
    tagged = company_tag.where(F.col("slug").startswith("src:") & (F.col("assigned_by") == "user")).select(F.col("company_id").alias("_cid")).distinct()
    flagged = companies.join(tagged, companies["id"] == tagged["_cid"], "left")
    active = (F.col("lifecycle_stage") != "nouveau") | F.col("_cid").isNotNull()
    return flagged.where(active if view == "actifs" else ~active).drop("_cid")


def contacts_of(contacts: DataFrame, companies: DataFrame, company_test: Column) -> DataFrame:
    """Contacts whose company passes a test."""
    good = companies.where(company_test).select(F.col("id").alias("_cid"))
    return contacts.join(good, contacts["company_id"] == good["_cid"], "left_semi")


def fresh_runs(runs: DataFrame, ttl_days: dict[str, int], default: int, as_of: str) -> DataFrame:
    """(company_id, source) scraped with success within the source's time to live."""
    ttl = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ttl_days.items() for x in kv]), F.col("source")), F.lit(default)) if ttl_days else F.lit(default)
    return runs.where((F.col("status") == "success") & (F.datediff(F.lit(as_of).cast("date"), F.col("started_at").cast("date")) < ttl)).select("company_id", "source").distinct()


def scrape_gate(candidates: DataFrame, fresh: DataFrame, opposed: DataFrame, cooling: DataFrame) -> DataFrame:
    """Candidates with the first reason against a scrape: fresh, opted_out, cooldown, or null."""
    f = fresh.select(F.col("company_id").alias("_f"), F.col("source").alias("_fs")).distinct()
    o = opposed.select(fingerprint(F.col("email")).alias("_o")).distinct()
    z = cooling.select(F.col("department_code").alias("_z")).distinct()
    joined = candidates.join(f, (candidates["id"] == f["_f"]) & (candidates["source"] == f["_fs"]), "left").join(o, fingerprint(candidates["email_generic"]) == o["_o"], "left").join(z, candidates["department_code"] == z["_z"], "left")
    return joined.withColumn("reason", F.when(F.col("_f").isNotNull(), "fresh").when(F.col("_o").isNotNull(), "opted_out").when(F.col("_z").isNotNull(), "cooldown")).drop("_f", "_fs", "_o", "_z")


def enrich_list(companies: DataFrame, contacts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Never enriched, or long ago and still without place or any address."""
    mailed = contacts.where(F.col("email").isNotNull()).select(F.col("company_id").alias("_cid")).distinct()
    flagged = companies.join(mailed, companies["id"] == mailed["_cid"], "left")
    stale = F.datediff(F.lit(as_of).cast("date"), F.col("enriched_on")) > days
    bare = F.col("lat").isNull() | (F.col("_cid").isNull() & F.col("email_generic").isNull())
    return flagged.where(F.col("enriched_on").isNull() | (stale & bare)).drop("_cid")


def link_unique_name(left: DataFrame, companies: DataFrame, name: str) -> DataFrame:
    """``left`` with company_id: by number, else by a normal name that only one company of the workspace has."""
    names = companies.groupBy("workspace_id", normalize_name(F.col("denomination")).alias("_norm")).agg(F.min("id").alias("_by_name"), F.count("*").alias("_n"))
    unique = names.where(F.col("_n") == 1).drop("_n").withColumnRenamed("workspace_id", "_ws")
    numbers = companies.where(F.col("siren").isNotNull()).groupBy("workspace_id", "siren").agg(F.min("id").alias("_by_siren")).select(F.col("workspace_id").alias("_ws2"), F.col("siren").alias("_siren"), "_by_siren")
    out = left.join(numbers, (left["workspace_id"] == F.col("_ws2")) & (left["siren"] == F.col("_siren")), "left")
    out = out.join(unique, (out["workspace_id"] == F.col("_ws")) & (normalize_name(out[name]) == F.col("_norm")), "left")
    how = F.when(F.col("_by_siren").isNotNull(), "siren").when(F.col("_by_name").isNotNull(), "name").otherwise("none")
    return out.withColumn("company_id", F.coalesce("_by_siren", "_by_name")).withColumn("linked_by", how).drop("_ws", "_ws2", "_norm", "_siren", "_by_name", "_by_siren")


def link_census(left: DataFrame, companies: DataFrame, name: str) -> DataFrame:
    """How many rows have one, several or no company of the same normal name."""
    names = companies.groupBy("workspace_id", normalize_name(F.col("denomination")).alias("_norm")).agg(F.count("*").alias("_n")).withColumnRenamed("workspace_id", "_ws")
    joined = left.join(names, (left["workspace_id"] == names["_ws"]) & (normalize_name(left[name]) == names["_norm"]), "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return joined.groupBy("workspace_id").agg(F.count_if(n == 1).alias("unique_names"), F.count_if(n > 1).alias("ambiguous"), F.count_if(n == 0).alias("without"))


def link_programmes(programmes: DataFrame, channels: DataFrame) -> DataFrame:
    """Programme ids with the channel of the same aggressive key; the lowest id wins."""
    keys = channels.groupBy(aggressive_key(F.col("name")).alias("_key")).agg(F.min("id").alias("channel_id")).where("_key <> ''")
    return programmes.join(keys, aggressive_key(programmes["name"]) == keys["_key"], "left").drop("_key")


def inherit(media: DataFrame, columns: tuple[str, ...] = ("email", "website", "phone")) -> DataFrame:
    """Empty columns of a child are filled from its parent."""
    parents = media.select(F.col("id").alias("_pid"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = media.join(parents, media["parent_media_id"] == parents["_pid"], "left")
    filled = {c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_p_{c}")) for c in columns}
    return joined.withColumns(filled).drop("_pid", *[f"_p_{c}" for c in columns])


def match_contacts(incoming: DataFrame, contacts: DataFrame) -> DataFrame:
    """Each incoming row with contact_id and how it was found, within its workspace.

    By external reference, then person key, then address (own company first), then normalised
    hash; of several contacts the smallest id.  Columns that either side lacks are passed over.
    """
    out, ids = incoming, []
    for key, name in (("external_ref", "r"), ("person_key", "p"), ("email", "m"), ("normalized_hash", "h")):
        if key not in incoming.columns or key not in contacts.columns:
            continue
        value = (lambda df, key=key: F.lower(F.trim(df[key]))) if key == "email" else (lambda df, key=key: df[key])
        known = contacts.where(F.col(key).isNotNull()).select(F.col("workspace_id").alias(f"_w{name}"), value(contacts).alias(f"_k{name}"), F.col("company_id").alias(f"_c{name}"), F.col("id").alias(f"_i{name}"))
        here = (incoming["workspace_id"] == F.col(f"_w{name}")) & (value(incoming) == F.col(f"_k{name}"))
        if key == "email":
            own = known.groupBy("_wm", "_km", "_cm").agg(F.min("_im").alias("_own"))
            out = out.join(own, here & (incoming["company_id"] == F.col("_cm")), "left").drop("_wm", "_km", "_cm")
            ids.append(("_own", "email_same_company"))
        least = known.groupBy(f"_w{name}", f"_k{name}").agg(F.min(f"_i{name}").alias(f"_i{name}"))
        out = out.join(least, here, "left").drop(f"_w{name}", f"_k{name}")
        ids.append((f"_i{name}", key))
    matched = F.lit("new")
    for column, label in reversed(ids):
        matched = F.when(F.col(column).isNotNull(), label).otherwise(matched)
    found = F.coalesce(*[F.col(c) for c, _ in ids]) if ids else F.lit(None).cast("long")
    return out.withColumn("contact_id", found).withColumn("matched_by", matched).drop(*[c for c, _ in ids])


def _grams_of(name: Column) -> Column:
    text = F.concat(F.lit("  "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a name padded as two spaces before and one after."""
    return _grams_of(normalize_name(c))


#: Ids of one name that are held in one array, at most some more.
CHUNK = 1000


def _coded(grams: Column) -> Column:
    """Trigrams as numbers of three code points, 21 bits each."""
    point = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    return F.transform(grams, lambda g: F.shiftleft(point(g, 1), 42) + F.shiftleft(point(g, 2), 21) + point(g, 3))


def _similar_classes(names: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of rows (rep, workspace_id, city, grams) of different names, a < b; each has a trigram.

    Candidates meet on rare trigrams only (prefix filter: of n trigrams in order of rarity the
    first n - ceil(threshold * n) + 1), so a large city is no all-pairs join. They carry their trigrams along and are
    judged where they meet.
    """
    posted = names.select("rep", "workspace_id", "city", F.explode_outer("grams").alias("g"))  # outer: else a filter computes the trigrams once more
    frequency = posted.groupBy("g").agg(F.count("*").alias("f"))
    ranked = posted.join(frequency, "g").groupBy("rep", "workspace_id", "city").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("r"))
    ordered = ranked.select("rep", "workspace_id", "city", F.col("r.g").alias("grams"))
    n = F.size("grams")
    prefix = ordered.select("*", F.explode(F.slice("grams", 1, (n - F.ceil(F.lit(threshold) * n) + 1).cast("int"))).alias("g"))
    a, b = (prefix.select(F.col("rep").alias(x), "workspace_id", "city", "g", F.col("grams").alias(f"{x}_grams")) for x in "ab")
    sizes = F.size("a_grams"), F.size("b_grams")
    near = (F.col("a") < F.col("b")) & (F.least(*sizes) >= F.lit(threshold) * F.greatest(*sizes))
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    similarity = common / (sizes[0] + sizes[1] - common)
    judged = a.join(b, ["workspace_id", "city", "g"]).where(near).select("a", "b", F.round(similarity, 6).alias("similarity"))
    return judged.where(F.col("similarity") >= threshold).distinct()


def similar_names(companies: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs (a, b), a < b, of one workspace and city whose names' trigram similarity reaches the threshold.

    Names are compared once each, by the smallest id that bears one; pairs of names are then dealt out as pairs of
    arrays of some CHUNK ids, so that neither a common name nor a large city is the work of one task.
    """
    key = ["workspace_id", "city", "_name"]
    rows = companies.where(F.col("city").isNotNull() & F.col("workspace_id").isNotNull()).select("id", "workspace_id", "city", F.coalesce("denomination", F.lit("")).alias("_name"))
    names = rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("_n"), F.min("_name").alias("_text"))
    texts = names.select("rep", "workspace_id", "city", normalize_name(F.col("_text")).alias("_text"))
    links = _similar_classes(texts.select("rep", "workspace_id", "city", _coded(_grams_of(F.col("_text"))).alias("grams")), threshold)
    links = names.where("_n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")).unionByName(links)
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / CHUNK))
    chunks = rows.join(names, key).groupBy("rep", part.alias("part")).agg(F.collect_list("id").alias("ids"))
    a, b = (chunks.select(F.col("rep").alias(x), F.col("part").alias(f"{x}_part"), F.col("ids").alias(f"{x}_ids")) for x in "ab")
    own = F.col("a") == F.col("b")
    pairs = links.join(a, "a").join(b, "b").where(~own | (F.col("a_part") <= F.col("b_part")))
    pairs = pairs.repartition(max(64, int(companies.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    once = own & (F.col("a_part") == F.col("b_part"))
    met = pairs.select("similarity", once.alias("once"), "b_ids", F.explode("a_ids").alias("x")).select("similarity", "once", "x", F.explode("b_ids").alias("y"))
    met = met.where((F.col("x") < F.col("y")) | (~F.col("once") & (F.col("x") > F.col("y"))))
    return met.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"), "similarity")


def keyset_page(df: DataFrame, column: str, size: int, after: tuple | None = None) -> DataFrame:
    """A page by (column desc nulls last, id desc): one row more than its size tells that more follow."""
    if after is not None:
        value, last = after
        c = F.col(column)
        beyond = (c.isNull() & (F.col("id") < last)) if value is None else (c < value) | ((c == value) & (F.col("id") < last)) | c.isNull()
        df = df.where(beyond)
    return df.orderBy(F.desc_nulls_last(column), F.desc("id")).limit(size + 1)


def latest_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
