"""Moving records on small hand-made tables: nulls, repeats, empty tables."""

import datetime
import json

from pyspark.sql import functions as F

from prospecta.operators import lifecycle as y

BOX = "event_type string, email_hash string, scope string, status string"
ASKED = "n int, event_type string, email_hash string, scope string, origin string"


def one(spark, made):
    return spark.range(1).select(made.alias("x")).first().x


def test_enqueue(spark):
    box = spark.createDataFrame([("erasure", "a", "vivier", "pending"), ("erasure", "b", "vivier", "sent"), ("erasure", "c", "business", "failed"), ("erasure", None, "vivier", "failed")], BOX)
    rows = [
        (1, "erasure", "a", "vivier", "crm"), (2, "erasure", "b", "vivier", "crm"), (3, "erasure", " b", "vivier", "crm"), (4, "erasure", "c", "vivier", "crm"), (5, "erasure", "d", "vivier", "site"),
        (6, "greeting", "d", "vivier", "crm"), (7, "erasure", "d", "other", "crm"), (8, "erasure", " ", "vivier", "crm"), (9, "erasure", None, "vivier", "crm"), (10, "erasure", "d", "vivier", None), (11, "consent_optin", "a", "vivier", "crm"),
    ]
    asked = spark.createDataFrame(rows, ASKED)
    assert sorted(r.n for r in y.enqueue(box, asked, "n").collect()) == [2, 4, 11]
    assert y.enqueue(box.where("false"), asked, "n").count() == 4
    assert y.enqueue(box, asked.where("false"), "n").count() == 0


def test_replies_keep_waiting_rows_alive(spark):
    now = datetime.datetime(2026, 1, 1)
    for code, attempts, expected in ((503, 9, ("deferred", 9, 60)), (0, 0, ("deferred", 0, 1)), (500, 6, ("failed", 7, 60)), (500, 7, ("gave_up", 8, None)), (422, 0, ("gave_up", 1, None)), (201, 3, ("sent", 4, None))):
        got = one(spark, y.after_reply(F.lit(code), F.lit(attempts), F.lit(now)))
        wait = got.next_attempt_at and (got.next_attempt_at - now).total_seconds() / 60
        assert (got.status, got.attempts, wait) == expected


def test_a_token_tells_nulls_apart(spark):
    rows = spark.createDataFrame([(None, "x"), ("x", None), ("", "x"), (None, None)], "a string, b string")
    assert rows.select(y.version_token("a", "b")).distinct().count() == 4
    assert rows.select(y.version_token("a", "b")).collect() == rows.select(y.version_token("b", "a")).collect()
    assert [one(spark, y.stale(F.lit(s).cast("string"), F.lit("t"))) for s in (None, "", " * ", '"t"', '"u", "t"', '"u"')] == [False, False, False, False, False, True]


def test_end_dates_leave_other_keys(spark):
    texts = ['{"wikidata_id":"Q1","url":"u","n":{"a":[1,null,"x"]}}', '{"wikidata_id":"Q2","ended_at":"1990-01-01"}', '{"wikidata_id":"Qx","ended_at":"1990-01-01"}', None, "not json"]
    media = spark.createDataFrame(list(enumerate(texts)), "id int, socials string")
    ends = spark.createDataFrame([("Q1", "2001-02-03"), ("Q1", "2004-05-06"), ("Q2", None), (None, "2000-01-01")], "qid string, ended_on string")
    got = [r.socials for r in y.mark_ended(media, ends, "now").orderBy("id").collect()]
    assert json.loads(got[0]) == {"wikidata_id": "Q1", "url": "u", "n": {"a": [1, None, "x"]}, "ended_at": "2004-05-06", "wikidata_status_checked_at": "now"}
    assert json.loads(got[1]) == {"wikidata_id": "Q2", "wikidata_status_checked_at": "now"}
    assert got[2:] == texts[2:]


def test_tags_sent_come_last_and_once(spark):
    tags = y.event_tags(F.lit("form_submission"), F.lit("audit"), F.lit("web"), F.lit("dev"), F.array(F.lit("vip"), F.lit("svc:audit")))
    assert one(spark, tags) == ["src:web", "svc:audit", "cand-offre:dev", "vip"]
    none = F.lit(None).cast("string")
    assert one(spark, y.event_tags(none, none, none, none, F.lit(None).cast("array<string>"))) == ["src:site-formulaire-autre"]


def test_names_and_addresses_of_nothing(spark):
    none = F.lit(None).cast("string")
    assert one(spark, y.office_email(F.array(none), none)) is None
    assert one(spark, y.office_email(F.array().cast("array<string>"), F.lit("a.fr"))) is None
    assert one(spark, y.registry_base(F.lit("S A S"))) == "S"
    assert one(spark, y.registry_match(none, F.lit("X"))) is None
