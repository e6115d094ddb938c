"""Enrichment of companies as a chain of derivations, each a column of the step before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as k


def derive(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """All derived columns of a company, as a write path keeps them: place, sector, size, score, badge, status.

    One scan of the companies and one semi-distinct of the contacts; a value that can't be
    derived is null and stops nothing after it.
    """
    reachable = contacts.where(k.contactable(F.col("email_status"))).select(F.col("company_id").alias("_cid")).distinct()
    df = companies.join(reachable, companies["id"] == reachable["_cid"], "left").withColumn("_reachable", F.col("_cid").isNotNull())
    df = df.withColumn("department", k.department(F.col("postcode")))
    df = df.withColumns({"region": k.region(F.col("department")), "sector": k.sector(F.col("naf")), "size": k.size_by_code(F.col("effectif_range"))})
    df = df.withColumn("score", k.quality_score({c: F.col(c) for c in companies.columns}, F.col("_reachable")))
    closed = F.coalesce(F.col("archive_reason") == "entreprise_radiee", F.lit(False))
    return df.withColumns({"badge": k.quality_badge(F.col("score")), "status": k.reachability(closed, F.col("_reachable"), F.col("email_generic"))}).drop("_cid", "_reachable")


def parse_people(reply: Column) -> Column:
    """People in a model's reply: the JSON list in it, with or without a fence; without a last name they don't count."""
    bare = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    people = F.from_json(bare, "array<struct<first_name:string,last_name:string,role:string,email:string>>")
    clean = F.transform(people, lambda p: F.struct(F.trim(p["first_name"]).alias("first_name"), F.trim(p["last_name"]).alias("last_name"), F.trim(p["role"]).alias("role"), F.lower(F.trim(p["email"])).alias("email")))
    return F.filter(F.coalesce(clean, F.array().cast("array<struct<first_name:string,last_name:string,role:string,email:string>>")), lambda p: F.length(p["last_name"]) > 0)
