"""Arbitration and place look-ups against small tables written out."""

from pyspark.sql import functions as F

from prospecta.operators import arbitration, places
from prospecta.plans import catalog

SF = "/root/testdata/sf0.001"


def test_decisions_in_turn(spark):
    acts = spark.createDataFrame([(1, "w", None, True), (2, "w", 9, True), (3, "w", None, False), (4, "w", None, True)], "activity_id long, workspace_id string, subject_id long, pending boolean")
    firms = spark.createDataFrame([(7, "w", None), (8, "other", None), (9, "w", "2026-01-01")], "id long, workspace_id string, deleted_on string")
    asked = [
        (1, 1, "dismiss", None, "spam"), (1, 2, "attach", 8, None), (1, 3, "attach", 7, None), (1, 4, "attach", 7, None), (1, 5, "dismiss", None, "later"),
        (2, 1, "attach", 7, None), (3, 1, "attach", 7, None), (4, 1, "attach", 9, None), (4, 2, "dismiss", None, "  a "), (4, 3, "attach", None, None), (4, 4, "dismiss", None, "x" * 501), (4, 5, "dismiss", None, "first"), (4, 6, "dismiss", None, "second"), (5, 1, "attach", 7, None),
    ]
    said = arbitration.arbitrate(acts, firms, spark.createDataFrame(asked, "activity_id long, decision_no int, action string, company_id long, reason string"))
    got = {(r.activity_id, r.decision_no): r.outcome for r in said.collect()}
    want = ["dismissed", "not_found", "attached", "conflict", "conflict", "conflict", "conflict", "not_found", "invalid", "invalid", "invalid", "dismissed", "dismissed", "not_found"]
    assert got == {a[:2]: w for a, w in zip(asked, want, strict=True)}
    rows = {r.activity_id: (r.subject_id, r.dismissed_reason) for r in arbitration.settled(acts, said).collect()}
    assert rows == {1: (7, "spam"), 2: (9, None), 3: (None, None), 4: (None, "second")}
    none = arbitration.arbitrate(acts.limit(0), firms.limit(0), said.drop("outcome").limit(0))
    assert none.count() == 0 and arbitration.settled(acts, none).count() == 4


def test_every_outcome_is_reached(spark):
    assert {r.outcome for r in catalog.queries()["m25_arbitration"](spark, SF).select("outcome").distinct().collect()} == {"attached", "dismissed", "conflict", "not_found"} | {"invalid"}


def test_places_of_odd_types(spark):
    docs = ['{"rating":"4.5","location":5,"types":{"a":1},"regularOpeningHours":{"weekdayDescriptions":["Mo",null,"Tu"]}}', "[]", "{", None, '{"internationalPhoneNumber":null,"nationalPhoneNumber":"01","formattedAddress":"x","businessStatus":true}']
    rows = spark.createDataFrame(enumerate(docs), "i int, doc string").select("i", places.flatten_place(F.try_parse_json("doc")).alias("p")).orderBy("i").collect()
    first, last = rows[0].p, rows[4].p
    assert (first.rating, first.lat, first.types, first.opening_hours) == (4.5, None, [], ["Mo", "Tu"])
    assert (last.phone, last.address, last.business_status) == ("01", "x", None)
    assert all(r.p.phone is None and r.p.types == [] for r in rows[1:4])


def test_retries_oldest_first_up_to_the_quota(spark):
    rows = [(1, "2026-02-01", '{"google_places_pending":1}'), (2, "2026-01-01", '{"google_places_pending":null,"google_places":{}}'), (3, None, '{"google_places_pending":1}'), (4, "2026-01-01", '{"google_places":{}}'), (5, "2026-01-01", None)]
    firms = spark.createDataFrame(rows, "id long, updated_at string, signals string")
    assert [r.id for r in places.retry_list(firms, 9).collect()] == [2, 1, 3]
    assert [r.id for r in places.retry_list(firms, 1).collect()] == [2]
