"""Queries of sources, exports and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import files
from ..streaming import ingest
from .registry import query


def scratch(spark) -> str:
    """A fresh folder under the shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="prospecta-")
    return f"{root.rstrip('/')}/feed-{uuid.uuid4().hex}"


def _lines(v):
    """Scraped records as JSON lines, made from events: bad versions, unknown keys and bad numbers among them."""
    n = F.col("event_id")
    company = F.named_struct(F.lit("siren"), F.when(n % 5 == 0, None).when(n % 11 == 0, "12").otherwise(F.lpad(n.cast("string"), 9, "0")), F.lit("country"), F.when(n % 13 == 0, "DE"))
    record = F.named_struct(F.lit("schema_version"), F.when(n % 17 == 0, 2).otherwise(1), F.lit("source"), F.lit("website"), F.lit("run_id"), F.concat(F.lit("r"), (n % 600).cast("string")), F.lit("status"), F.when(F.col("event_type") == "error", "failed").otherwise("success"), F.lit("company"), company)
    text = F.to_json(record)
    return v.events.select(F.when(n % 19 == 0, F.regexp_replace(text, "^\\{", '{"extra":1,')).when(n % 23 == 0, "{broken").otherwise(text).alias("value"))


@query(
    "s05_jsonl_records",
    """SELECT CASE WHEN event_id % 19 <> 0 AND event_id % 23 = 0 THEN 'not_json,version,no_run_id,status' ELSE array_to_string(list_filter([CASE WHEN event_id % 19 = 0 THEN 'unknown_key' END, CASE WHEN event_id % 17 = 0 THEN 'version' END, CASE WHEN event_id % 5 <> 0 AND event_id % 11 = 0 THEN 'siren' END,
 CASE WHEN event_id % 5 <> 0 AND event_id % 13 = 0 THEN 'siren_outside_france' END], lambda x: x IS NOT NULL), ',') END AS errors, count(*) AS n FROM events GROUP BY 1""",
)
def records(v):
    return files.parse_records(_lines(v)).groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


@query("s05_record_anchors", "SELECT CASE WHEN event_type = 'error' THEN 'skipped_failed' WHEN event_id % 5 <> 0 THEN 'siren' ELSE 'pending_match' END AS anchor, count(*) AS n FROM events WHERE event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 17 <> 0 AND NOT (event_id % 5 <> 0 AND (event_id % 11 = 0 OR event_id % 13 = 0)) GROUP BY 1")
def anchors(v):
    return files.split_records(files.parse_records(_lines(v)))[0].groupBy("anchor").agg(F.count("*").alias("n"))


@query("s07_naf_routing", "SELECT CASE length(c) WHEN 2 THEN 'divisions' WHEN 3 THEN 'groups' WHEN 4 THEN 'classes' ELSE 'subclasses' END AS level, count(*) AS n FROM (SELECT substr(lpad((c_custkey % 97)::VARCHAR, 2, '0') || '12Z', 1, CAST(2 + c_custkey % 4 AS INT)) AS c FROM customer) GROUP BY 1")
def naf(v):
    code = F.concat(F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), F.lit("12Z"))
    dotted = F.regexp_replace(F.substring(code, F.lit(1), (F.col("c_custkey") % 4 + 2).cast("int")), "^(..)(.+)$", "$1.$2")
    out = None
    for level, rows in files.route_naf(v.customer.select(dotted.alias("code"), F.lit("x").alias("label"))).items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("s19_mail_events", "SELECT CASE WHEN event_type = 'error' THEN 'hard_bounce' ELSE 'opened' END AS event, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM events GROUP BY 1")
def mail(v):
    kind = F.when(F.col("event_type") == "error", "hard_bounce").otherwise("opened")
    a = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.fr"))
    single = F.to_json(F.named_struct(F.lit("event"), kind, F.lit("email"), a, F.lit("reason"), F.lit("r")))
    both = F.to_json(F.array(F.named_struct(F.lit("event"), kind, F.lit("emails"), F.array(a, F.concat(F.lit("z"), a)))))
    return files.flatten_mail_events(v.events.select(F.when(F.col("event_id") % 3 == 0, both).otherwise(single).alias("value"))).groupBy("event").agg(F.count("*").alias("n"))


@query("s20_employers", "SELECT DISTINCT siren FROM (SELECT lpad((o_custkey)::VARCHAR, 9, '0') AS siren FROM orders) WHERE siren IN (SELECT lpad(c_custkey::VARCHAR, 9, '0') FROM customer WHERE c_acctbal > 0)")
def employers(v):
    offers = v.orders.select(F.concat(F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("00011")).alias("siret"))
    return files.unique_employers(offers, v.customer.where("c_acctbal > 0").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("siren"))).select("siren")


@query("k02_company_export", "SELECT c.id, denomination, coalesce(x, '') AS contacts FROM companies c LEFT JOIN (SELECT company_id, string_agg(concat_ws(' ', first_name, last_name), ' | ' ORDER BY id) AS x FROM contacts GROUP BY company_id) t ON c.id = t.company_id", ("companies", "contacts"))
def export(v):
    return files.company_export(v.companies, v.contacts).select("id", "denomination", "contacts")


@query("k09_dry_run", "SELECT count(*) AS incoming, count(*) FILTER (id IS NULL) AS would_insert FROM (SELECT b.cppap_number, m.id FROM (SELECT DISTINCT cppap_number FROM media_batch WHERE present) b LEFT JOIN media m ON m.cppap_number = b.cppap_number)", ("media_batch", "media"))
def dry_run(v):
    batch = v.media_batch.where("present").select("cppap_number").distinct()
    return batch.join(v.media.select("cppap_number", "id"), "cppap_number", "left").agg(F.count("*").alias("incoming"), F.count_if(F.col("id").isNull()).alias("would_insert"))


def _stream(v):
    head, _, tail = f"{v.sf_dir}/events.parquet".rpartition("/")
    return v.spark.readStream.schema(v.events.schema).parquet(f"{head}/[{tail[0]}]{tail[1:]}")


@query("st_windowed_counts", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windows(v):
    stream = ingest.windowed_counts(_stream(v).withColumn("ts", F.col("ts").cast("timestamp")))
    table = ingest.run_to_table(stream, v.spark, scratch(v.spark), "update")
    return table.groupBy("window_start", "event_type").agg(F.max_by("n", "epoch").alias("n"), F.max_by("total", "epoch").alias("total")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
