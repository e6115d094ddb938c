"""File sources with closed contracts, and export sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A scraped record, version 1: keys outside are refused.
RECORD_KEYS = ("schema_version", "source", "run_id", "fetched_at", "status", "company", "persons", "channels", "evidence", "confidence", "payload", "emails", "phones", "error", "latency_ms")
RECORD = (
    "schema_version int, source string, run_id string, fetched_at string, status string, "
    "company struct<siren:string,foreign_id:string,country:string,nature:string,match_hint:struct<denomination:string,postcode:string,city:string,address:string>,fields:struct<denomination:string,website:string,phone:string,email_generic:string,address:string,postcode:string,city:string,linkedin_url:string>>, "
    "persons array<struct<first_name:string,last_name:string,role:string,email:string,phone:string,linkedin_url:string,kind:string>>, channels struct<emails:array<string>,phones:array<string>>, confidence int"
)
EVENT_KEYS = ("schema_version", "event_id", "event_type", "form_type", "occurred_at", "subject_ref", "source_slug", "person", "company", "consent", "candidate", "tags", "payload")
EVENT = "schema_version int, event_id string, event_type string, form_type string, occurred_at string, subject_ref string, source_slug string, person struct<person_key:string,email:string,first_name:string,last_name:string,phone:string>, company struct<siren:string,name:string,postcode:string,city:string,website:string>, consent struct<version:string,at:string,text_ref:string>, tags array<string>"


def _errors(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), code) for test, code in rules]))


def parse_records(lines: DataFrame, source: str | None = None) -> DataFrame:
    """(value, record, errors) of JSON lines; blank lines are skipped.  ``lines`` may be a stream."""
    rows = lines.where(F.trim("value") != "")
    r = F.from_json("value", RECORD)
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    rows = rows.withColumn("record", r).withColumn("keys", keys)
    siren, foreign, country = (F.col(f"record.company.{c}") for c in ("siren", "foreign_id", "country"))
    return rows.withColumn(
        "errors",
        _errors(
            (F.col("record").isNull() | (F.size("keys") == 0), "not_json"),
            (F.size(F.array_except("keys", F.array(*map(F.lit, RECORD_KEYS)))) > 0, "unknown_key"),
            (~F.col("record.schema_version").eqNullSafe(F.lit(1)), "version"),
            (F.col("record.run_id").isNull(), "no_run_id"),
            (F.col("record.status").isNull() | ~F.col("record.status").isin("success", "partial", "failed"), "status"),
            (siren.isNotNull() & ~siren.rlike("^[0-9]{9}$"), "siren"),
            (country.isNotNull() & ~country.rlike("^[A-Z]{2}$"), "country"),
            (foreign.isNotNull() & country.isNull(), "foreign_id_without_country"),
            (siren.isNotNull() & country.isNotNull() & (country != "FR"), "siren_outside_france"),
            (F.col("record.source") != source if source else F.lit(False), "source"),
        ),
    ).drop("keys")


def split_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records, flat, with their anchor; and refused lines with the reasons."""
    good = parsed.where(F.size("errors") == 0).select("record.*")
    anchor = F.when(F.col("status") == "failed", "skipped_failed").when(F.col("company.siren").isNotNull(), "siren").when(F.col("company.foreign_id").isNotNull(), "foreign_id").otherwise("pending_match")
    return good.withColumn("anchor", anchor), parsed.where(F.size("errors") > 0).select("value", "errors")


def parse_events(lines: DataFrame) -> DataFrame:
    """(value, event, errors) of site events."""
    rows = lines.where(F.trim("value") != "").withColumn("event", F.from_json("value", EVENT)).withColumn("keys", F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    return rows.withColumn(
        "errors",
        _errors(
            (F.col("event").isNull() | (F.size("keys") == 0), "not_json"),
            (F.size(F.array_except("keys", F.array(*map(F.lit, EVENT_KEYS)))) > 0, "unknown_key"),
            (~F.col("event.schema_version").eqNullSafe(F.lit(1)), "version"),
            (F.col("event.event_id").isNull() | F.col("event.event_type").isNull() | F.col("event.subject_ref").isNull(), "incomplete"),
            (F.col("event.occurred_at").try_cast("timestamp").isNull(), "occurred_at"),
        ),
    ).drop("keys")


def read_csv_mapped(spark: SparkSession, path: str, names: dict[str, list[str]], sep: str = ",") -> DataFrame:
    """CSV whose columns are found by any of several header names; missing ones are null."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    have = {re.sub(r"\s+", " ", c.strip().lower()): c for c in df.columns}
    found = {k: next((have[n.lower()] for n in options if n.lower() in have), None) for k, options in names.items()}
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(k) if c else F.lit(None).cast("string").alias(k) for k, c in found.items()])


def route_naf(codes: DataFrame) -> dict[str, DataFrame]:
    """A nomenclature's rows (code, label) by the length of the code without dots."""
    bare = codes.withColumn("code", F.regexp_replace(F.trim("code"), r"\.", ""))
    return {name: bare.where(F.length("code") == n) for name, n in (("divisions", 2), ("groups", 3), ("classes", 4), ("subclasses", 5))}


def read_geojson(spark: SparkSession, path: str, min_population: int = 0) -> DataFrame:
    """(code, name, population, geometry) of a feature collection."""
    schema = "features array<struct<properties:struct<code:string,nom:string,population:long>,geometry:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties.code", F.col("f.properties.nom").alias("name"), "f.properties.population", "f.geometry").where(F.coalesce("population", F.lit(0)) >= min_population)


def read_xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """First sheet of each workbook under ``path``: the header row names the columns, by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = sheet_rows(content)
                at = {h: i for i, h in enumerate(rows[0])} if rows else {}
                yield pa.RecordBatch.from_arrays([pa.array([r[at[c]] if c in at and at[c] < len(r) else None for r in rows[1:]], pa.string()) for c in columns], names=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    out = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells: list[str | None] = []
        for c in row.findall("m:c", ns):
            letters = re.match("[A-Z]+", c.get("r", "A")).group()
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            cells += [None] * (col - len(cells))
            value = c.find("m:v", ns)
            text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) or None
            cells[col - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        out.append(cells)
    return out


def fold_bindings(bindings: DataFrame) -> DataFrame:
    """One row for each entity of flat query bindings (qid, genre, role, person)."""
    return bindings.groupBy("qid").agg(F.first("genre", ignorenulls=True).alias("genre"), F.sort_array(F.collect_set(F.when(F.col("person").isNotNull(), F.struct("role", "person")))).alias("people"))


def flatten_mail_events(lines: DataFrame) -> DataFrame:
    """(event, email, detail) of provider messages: an object, or a list of them, with one or many addresses."""
    item = "struct<event:string,email:string,emails:array<string>,reason:string,message:string>"
    one = F.from_json("value", item)
    many = F.from_json("value", f"array<{item}>")
    items = F.when(F.ltrim("value").startswith("["), many).otherwise(F.array(one))
    rows = lines.select(F.explode(items).alias("m"))
    addresses = F.coalesce("m.emails", F.array("m.email"))
    return rows.select(F.col("m.event").alias("event"), F.explode_outer(addresses).alias("email"), F.coalesce("m.reason", "m.message").alias("detail")).where("email is not null")


def unique_employers(offers: DataFrame, active: DataFrame) -> DataFrame:
    """One row for each employer number of job offers that the registry has as active."""
    rows = offers.withColumn("siren", F.substring("siret", 1, 9)).where(F.length("siren") == 9).dropDuplicates(["siren"])
    return rows.join(active.select("siren").distinct(), "siren", "left_semi")


def write_export(df: DataFrame, path: str, order: list[str], cap: int = 50_000) -> None:
    """CSV with header for people: at most ``cap`` rows, then a row that says so.

    One file is asked for, so the rows that go to it are bounded by the cap.
    """
    top = df.orderBy(*order).limit(cap + 1)
    numbered = top.select(F.monotonically_increasing_id().alias("_n"), *[F.col(c).cast("string").alias(c) for c in df.columns]).coalesce(1)
    body = numbered.orderBy("_n").limit(cap)
    marker = numbered.agg(F.count("*").alias("_c")).where(F.col("_c") > cap).select(F.lit(2**62).alias("_n"), F.lit(f"TRUNCATED AT {cap} ROWS").alias(df.columns[0]), *[F.lit(None).cast("string").alias(c) for c in df.columns[1:]])
    bom = "﻿"
    body.unionByName(marker).coalesce(1).sortWithinPartitions("_n").drop("_n").withColumnRenamed(df.columns[0], bom + df.columns[0]).write.mode("overwrite").option("header", True).csv(path)


def company_export(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Companies with their contacts in one cell and a map link."""
    people = contacts.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat_ws(" ", "first_name", "last_name").alias("n")))), lambda x: x["n"]), " | ").alias("contacts"))
    place = F.concat_ws(" ", "address", "postcode", "city")
    joined = companies.join(people, companies["id"] == people["company_id"], "left")
    return joined.select("id", "denomination", F.coalesce("contacts", F.lit("")).alias("contacts"), F.concat(F.lit("https://maps.example/?q="), F.url_encode(place)).alias("map_url"))


def encrypted_bundle(records: DataFrame, key: str) -> DataFrame:
    """Records as encrypted JSON, one cell each."""
    return records.select(F.base64(F.aes_encrypt(F.to_json(F.struct(*records.columns)), F.lit(key))).alias("cipher"))


def refresh_table(df: DataFrame, path: str) -> None:
    """Rewrite a derived table: a new version beside the old one, then a pointer that readers follow."""
    spark = df.sparkSession
    version = f"{path}/v={spark.range(1).select(F.uuid()).first()[0]}"
    df.write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.schema("version string").json(f"{path}/current").first()["version"])
