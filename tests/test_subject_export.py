"""Exports where many requests ask for one address and rows are found in several ways."""

import pytest
from pyspark.sql import functions as F

from prospecta.operators import subjects as sj
from prospecta.plans import catalog
from prospecta.sources.people import PEOPLE
from prospecta.sources.views import Views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shared", [False, True])
def test_each_row_once_for_each_request(spark, monkeypatch, tmp_path, shared):
    monkeypatch.setattr(sj, "CHUNK", 2)
    v = Views(spark, SF)
    held = {n.removeprefix("held_"): getattr(v, n).limit(0 if n not in ("held_activities", "held_email_messages", "held_contacts", "held_users", "held_sessions", "held_opt_out") else 10**6) for n in PEOPLE if n.startswith("held_") and n != "held_runs"}
    held["activities"] = held["activities"].where("id < 300").unionByName(spark.createDataFrame([(10**6 + i, "w0", key, payload, content, title) for i, (key, payload, content, title) in enumerate([("k", "x a@site.fr", "A@SITE.FR a@site.fr", "a@site.fr"), ("k", None, "a@site.fr", None), ("k", None, None, None), ("", "b@site.fr", None, "a@site.fr")])], held["activities"].schema))
    held["email_messages"] = held["email_messages"].where("id < 200").unionByName(spark.createDataFrame([(10**6, "A@site.fr", "b@site.fr, a@site.fr"), (10**6 + 1, None, "a@site.fr")], held["email_messages"].schema))
    held["contacts"] = held["contacts"].where("id < 200").unionByName(spark.createDataFrame([(10**6 + i, "w0", mail, None, "k", None, None, None) for i, mail in enumerate(["a@site.fr", "A@site.fr", None])], held["contacts"].schema))
    requests = [(i, mail, None) for i, mail in enumerate(["a@site.fr", " A@Site.fr ", "b@site.fr", "a@site.fr", "nobody", None] * 3)]
    asked = v.asked.select(F.col("request_id").cast("long") + 1000, "email", "phone").unionByName(spark.createDataFrame(requests, "`(CAST(request_id AS BIGINT) + 1000)` long, email string, phone string")).toDF("request_id", "email", "phone")
    who, want = sj.Subjects(held, asked), []
    for h in sj.HELD:
        want += [(r.request_id, h.name, str(r.id)) for r in who.pairs(held[h.name], h.finds).collect()]
    got = sj.export(held, asked, f"file://{tmp_path}" if shared else None).select("request_id", "relation", F.col("id").cast("string"), "record").collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(want)
    assert {"activities", "email_messages", "contacts", "users", "sessions", "opt_out"} <= {r.relation for r in got}


def test_found_rows_are_not_gathered(spark):
    """No pair of a row and a request is shuffled: requests come last, to what the distinct addresses found."""
    plan = catalog.queries()["m07_subject_export"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.index("Generate explode(_ids") < plan.index("Join")
