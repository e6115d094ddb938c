"""Queries of what is pending: place look-ups and records to be arbitrated."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arbitration as a
from ..operators import places as p
from .registry import query

_E = "CAST(event_id AS BIGINT)"


@query(
    "s21_place_flatten",
    f"""SELECT event_id, CASE WHEN n % 7 = 0 OR n % 3 = 1 THEN NULL WHEN n % 3 = 0 THEN '+33' || n ELSE '0' || n END AS phone, CASE WHEN n % 7 > 0 AND n % 2 = 0 THEN 'https://s' || n || '.fr' END AS website,
CASE WHEN n % 7 > 0 AND n % 4 < 3 THEN CAST(n AS DOUBLE) END AS lat, CASE WHEN n % 7 > 0 AND n % 4 < 3 THEN 2.5::DOUBLE END AS lon, CASE WHEN n % 7 > 0 AND n % 6 > 0 THEN 4.5::DOUBLE END AS rating, CASE WHEN n % 7 > 0 THEN n % 100 END AS user_rating_count,
CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN '' ELSE 'bank atm' END AS types, CASE WHEN n % 7 > 0 THEN 'p' || n END AS google_place_id, CASE WHEN n % 7 > 0 AND n % 9 > 0 THEN event_type END AS display_name FROM (SELECT *, {_E} AS n FROM events)""",
)
def places(v):
    n = F.col("event_id").cast("long")
    at = n.cast("string")
    part = lambda when, yes, no: F.when(when, yes).otherwise(no)
    doc = F.concat(
        F.lit('{"id":"p'), at, F.lit('","nationalPhoneNumber":"0'), at, F.lit('","internationalPhoneNumber":'),
        F.when(n % 3 == 0, F.concat(F.lit('"+33'), at, F.lit('"'))).when(n % 3 == 1, at).otherwise("null"),
        F.lit(',"websiteUri":'), part(n % 2 == 0, F.concat(F.lit('"https://s'), at, F.lit('.fr"')), F.lit("5")),
        part(n % 4 < 3, F.concat(F.lit(',"location":{"latitude":'), at, F.lit(',"longitude":2.5}')), F.lit("")),
        part(n % 6 > 0, F.lit(',"rating":4.5'), F.lit("")),
        F.lit(',"userRatingCount":'), (n % 100).cast("string"),
        F.lit(',"types":'), part(n % 5 == 0, F.lit('"bank"'), F.lit('["bank",3,"atm"]')),
        F.lit(',"displayName":'), part(n % 9 > 0, F.concat(F.lit('{"text":"'), F.col("event_type"), F.lit('"}')), F.lit("7")), F.lit("}"),
    )
    flat = p.flatten_place(F.try_parse_json(F.when(n % 7 > 0, doc)))
    return v.events.select("event_id", flat.alias("f")).select("event_id", "f.phone", "f.website", "f.lat", "f.lon", "f.rating", "f.user_rating_count", F.array_join("f.types", " ").alias("types"), "f.google_place_id", "f.display_name")


@query("p35_places_retry", "SELECT id FROM companies WHERE id % 5 IN (1, 2, 4) AND id % 11 > 0 ORDER BY created_on NULLS LAST, id LIMIT 100", ("companies",))
def places_retry(v):
    signals = ('{"n":1}', '{"google_places_pending":{"since":"2026-05"}}', '{"google_places_pending":null}', '{"google_places_pending":true,"google_places":{"enriched_at":"2026-06-01"}}', '{"google_places_pending":true,"google_places":{"enriched_at":null}}')
    nth = F.element_at(F.array(*map(F.lit, signals)), (F.col("id") % 5).cast("int") + 1)
    return p.retry_list(v.companies.withColumn("signals", F.when(F.col("id") % 11 == 0, '{"google_places_pending":').otherwise(nth)), 100, "created_on").select("id")


_DECISIONS = f"""acts AS (SELECT {_E} AS activity_id, 'w1' AS workspace_id, CASE WHEN event_type = 'purchase' THEN 1 END AS subject_id, {_E} % 4 < 3 AS pending, CAST(user_id AS BIGINT) AS u FROM events),
dec AS (SELECT activity_id, 1 AS decision_no, CASE WHEN activity_id % 2 = 0 THEN 'attach' ELSE 'dismiss' END AS action, u * 3 AS company_id, CASE WHEN activity_id % 6 = 1 THEN ' no ' ELSE 'spam' END AS reason, subject_id, pending, workspace_id FROM acts
 UNION ALL SELECT activity_id, 2, CASE WHEN activity_id % 3 = 0 THEN 'attach' ELSE 'dismiss' END, u, 'again', subject_id, pending, workspace_id FROM acts
 UNION ALL SELECT -activity_id - 1, 3, 'attach', u, NULL, NULL, NULL, NULL FROM acts WHERE activity_id % 5 = 0),
seen AS (SELECT d.*, c.id IS NOT NULL AS live, max(CASE WHEN action = 'attach' AND subject_id IS NULL AND pending AND c.id IS NOT NULL AND company_id >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY activity_id ORDER BY decision_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM dec d LEFT JOIN companies c ON c.id = d.company_id AND c.workspace_id = d.workspace_id AND c.deleted_on IS NULL),
done AS (SELECT activity_id, decision_no, action, company_id, reason, CASE WHEN action = 'attach' AND company_id < 1 OR action = 'dismiss' AND reason = ' no ' THEN 'invalid' WHEN activity_id < 0 THEN 'not_found' WHEN subject_id IS NOT NULL OR coalesce(before, 0) = 1 THEN 'conflict'
 WHEN action = 'dismiss' THEN 'dismissed' WHEN NOT pending THEN 'conflict' WHEN NOT live THEN 'not_found' ELSE 'attached' END AS outcome FROM seen)"""


def _pending(v):
    """Each event as an activity, and two decisions on it; some more on activities that don't exist."""
    acts = v.events.select(F.col("event_id").cast("long").alias("activity_id"), F.lit("w1").alias("workspace_id"), F.when(F.col("event_type") == "purchase", F.lit(1).cast("long")).alias("subject_id"), (F.col("event_id") % 4 < 3).alias("pending"), F.col("user_id").cast("long").alias("u"))
    n = F.col("activity_id")
    first = acts.select(n, F.lit(1).alias("decision_no"), F.when(n % 2 == 0, "attach").otherwise("dismiss").alias("action"), (F.col("u") * 3).alias("company_id"), F.when(n % 6 == 1, " no ").otherwise("spam").alias("reason"))
    second = acts.select(n, F.lit(2).alias("decision_no"), F.when(n % 3 == 0, "attach").otherwise("dismiss").alias("action"), F.col("u").alias("company_id"), F.lit("again").alias("reason"))
    lost = acts.where(n % 5 == 0).select((-n - 1).alias("activity_id"), F.lit(3).alias("decision_no"), F.lit("attach").alias("action"), F.col("u").alias("company_id"), F.lit(None).cast("string").alias("reason"))
    return acts.drop("u"), a.arbitrate(acts, v.companies, first.unionAll(second).unionAll(lost))


@query("m25_arbitration", "SELECT activity_id, decision_no, outcome FROM done", ("companies",), _DECISIONS)
def arbitration(v):
    return _pending(v)[1].select("activity_id", "decision_no", "outcome")


@query("m25_settled", "SELECT activity_id, coalesce(any_value(a.subject_id), max(company_id) FILTER (outcome = 'attached')) AS subject_id, trim(arg_max(reason, decision_no) FILTER (outcome = 'dismissed')) AS dismissed_reason FROM acts a LEFT JOIN done USING (activity_id) GROUP BY activity_id", ("companies",), _DECISIONS)
def after(v):
    return a.settled(*_pending(v)).select("activity_id", "subject_id", "dismissed_reason")
