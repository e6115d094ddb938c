"""Operators on small hand-made tables: nulls, second tenants, replays, refusals."""

import hashlib
import hmac
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from prospecta import context
from prospecta.functions import classify, contact, mailboxes, text
from prospecta.operators import criteria as cr
from prospecta.operators import merge, relations, rollups
from prospecta.sources import files
from prospecta.streaming import ingest


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


# --- workspaces


def test_reads_need_a_workspace(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("w1", 1, None), ("w2", 2, None), ("w1", 3, "x")], "workspace_id string, id int, deleted_at string").write.parquet(path)
    with pytest.raises(context.MissingWorkspace):
        context.table(spark, path)
    with context.Workspace("w1").use():
        df = context.table(spark, path)
        assert [r.id for r in df.collect()] == [1]
        assert "workspace_id" in df._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
        assert context.table(spark, path, live_only=False).count() == 2
    with context.without_scope("monthly census"):
        assert context.table(spark, path).count() == 2
    for bad in ("", "a b", "w1' or 1=1"):
        with pytest.raises(ValueError):
            context.Workspace(bad)
    with pytest.raises(ValueError), context.without_scope(" "):
        pass


# --- criteria: the twelve companies

AUD = [
    ("isere-pme-A", "38", "PME", "btp", "A", "ready_for_outreach"), ("isere-tpe-B", "38", "TPE", "sante", "B", "pending"), ("rhone-pme-C", "69", "PME", "btp", "C", "pending"),
    ("rhone-null-null", "69", None, None, None, "pending"), ("paris-eti-B", "75", "ETI", "droit", "B", "partial_email"), ("nulldep-pme-A", None, "PME", "btp", "A", "pending"),
    ("nulldep-null-C", None, None, "sante", "C", "pending"), ("nulldep-tout-null", None, None, None, None, "pending"), ("nulldep-tout-null-2", None, None, None, None, "archived_no_email"),
    ("isere-null-conf", "38", "PME", "droit", None, "pending"), ("rhone-null-taille", "69", None, "btp", "B", "ready_for_outreach"), ("paris-null-secteur", "75", "TPE", None, "A", "pending"),
]


@pytest.fixture(scope="module")
def audience(spark):
    companies = spark.createDataFrame([(*r, "x@y.fr" if r[0] == "rhone-pme-C" else None) for r in AUD], "id string, department_code string, size_category string, sector_main string, best_email_confidence string, prospection_status string, email_generic string")
    contacts = spark.createDataFrame([("paris-eti-B", "valid"), ("isere-tpe-B", "invalid"), ("paris-eti-B", None)], "company_id string, email_status string")
    tags = spark.createDataFrame([("isere-pme-A", "secteur:btp")], "company_id string, slug string")
    return lambda c: {r.id for r in cr.segment(companies, contacts, tags, c).collect()}


def one(field, op, value=None, block="all"):
    return {block: [{"field": field, "op": op, "value": value}]}


def test_null_semantics(audience):
    every = {r[0] for r in AUD}
    isere = {"isere-pme-A", "isere-tpe-B", "isere-null-conf"}
    assert audience(one("department_code", "eq", "38")) == isere
    assert audience(one("department_code", "eq", "38", "not")) == every - isere
    assert audience(one("department_code", "neq", "38")) == every - isere
    assert audience(one("department_code", "neq", "38", "not")) == isere
    assert audience(one("has_email", "eq", True)) == {"paris-eti-B", "rhone-pme-C"}
    assert audience(one("has_email", "eq", False)) == every - {"paris-eti-B", "rhone-pme-C"}
    assert audience(one("tags", "contains_any", [])) == set() and audience({"any": []}) == every
    assert audience(one("tags", "contains_any", ["secteur:btp"], "not")) == every - {"isere-pme-A"}


CONDITIONS = [("department_code", "in", ["38", "75"]), ("size_category", "not_in", ["PME"]), ("best_email_confidence", "lte", "B"), ("best_email_confidence", "gt", "A"), ("sector_main", "is_null", None), ("sector_main", "is_not_null", None), ("size_category", "neq", "TPE"), ("prospection_status", "eq", "pending")]


@pytest.mark.parametrize("field,op,value", CONDITIONS)
@pytest.mark.parametrize("block", ["all", "not"])
def test_against_plain_python(audience, field, op, value, block):
    at = {"department_code": 1, "size_category": 2, "sector_main": 3, "best_email_confidence": 4, "prospection_status": 5}[field]
    test = {
        "eq": lambda x: x == value, "neq": lambda x: x != value, "in": lambda x: x in value, "not_in": lambda x: x not in value, "gt": lambda x: x is not None and x > value,
        "lte": lambda x: x is not None and x <= value, "is_null": lambda x: x is None, "is_not_null": lambda x: x is not None,
    }[op]
    assert audience(one(field, op, value, block)) == {r[0] for r in AUD if test(r[at]) != (block == "not")}


@pytest.mark.parametrize("bad", [{"some": []}, {"all": {}}, one("name", "eq", "x"), one("naf", "like", "x"), one("naf", "in", "x"), one("has_email", "neq", True), {"all": ["x"]}])
def test_refused_criteria(bad):
    with pytest.raises(cr.InvalidCriteria):
        cr.compile_criteria(bad)


def test_rules_into_json(spark):
    df = spark.createDataFrame([(1, '{"recent":[{"kind":"hire"}],"n":5}'), (2, "{}"), (3, None)], "id int, signals string")
    rules = {"a": {"field": "signals.recent[0].kind", "op": "=", "value": "hire"}, "b": {"field": "signals.n", "op": ">=", "value": 5}, "c": {"field": "signals.n", "op": "??", "value": 1}}
    assert {(r.company_id, r.slug) for r in cr.apply_rules(df, rules).collect()} == {(1, "a"), (1, "b")}


# --- scalars


def test_names(spark):
    assert column(spark, ["Société  de la Forge", "L'Été", None, "DELAge du Nord", "Noël l ami"], text.normalize_name) == ["societe forge", "l'ete", "", "delage nord", "noel ami"]
    assert column(spark, ["Directeur DRH", "CTO", "Chief Executive Officer", None, "assistant"], text.position) == ["drh", "other", "ceo", "other", "other"]


def test_hashes(spark):
    mails = [" A@X.fr ", "é@x.fr", None]
    assert column(spark, mails, contact.fingerprint) == [hashlib.sha256(m.strip().lower().encode()).hexdigest() if m else None for m in mails]
    for secret in ("k", "k" * 100):
        got = column(spark, ["a@x.fr", "  ", None], lambda c, s=secret: contact.person_key(c, s))
        assert got == [hmac.new(secret.encode(), b"person:a@x.fr", "sha256").hexdigest(), None, None]


def test_places_and_sizes(spark):
    assert column(spark, ["75008", "20000", "20200", "97110", "9", None, "98"], classify.department) == ["75", "2A", "2B", "971", None, None, None]
    assert column(spark, ["1000", "20199", "20200"], classify.department_importer) == ["01", "2A", "2B"]
    assert column(spark, ["21", "52", "xx", None], classify.size_by_code) == ["pme", "grande", None, None]
    assert column(spark, ["6201Z", "4321A", "0000Z", None], classify.sector) == ["it_saas", "btp", "autre", None]
    assert column(spark, ["38", "2A", "971", "00"], classify.region) == ["84", "94", "01", None]


def test_addresses(spark):
    page = 'Write to <a href="mailto:Contact@boulangerie-mock.fr">us</a>, 01 42 33 22 11 or logo@2x.png'
    assert column(spark, [page], mailboxes.usable_emails, "string") == [["contact@boulangerie-mock.fr"]]
    assert column(spark, [page, "+33 1 42 33 22 11"], contact.french_phones) == [["0142332211"], ["0142332211"]]
    assert column(spark, ["ab@c.fr", "nothing", "@x", "", None], contact.mask_email) == ["a***@c.fr", "***", "***", "", None]
    assert column(spark, ["+33612345678", "123", None], contact.mask_phone) == ["+336******78", "***", None]
    assert column(spark, ["https://www.Shop.co.uk:8/x", "site.fr/a?b", "nodot", None], lambda c: contact.registrable(contact.site_host(c))) == ["shop.co.uk", "site.fr", None, None]
    assert column(spark, ["10.1.2.3", "8.8.8.8", "172.20.0.1", "bad"], contact.ip_denied) == [True, False, True, True]
    assert column(spark, ["1.2.3.4", "2001:db8:1:2::5"], contact.mask_ip) == ["1.2.3.0", "2001:db8:1::"]


# --- merges


@pytest.fixture
def state(spark):
    rows = [(1, "C1", "Old", None, None), (2, "C2", "Same", "a@b.fr", None), (3, "C3", "Gone", None, None), (4, "C4", "Back", "x@y.fr", "2026-01-01"), (5, "C5", "Archived", None, "2026-01-01")]
    return spark.createDataFrame(rows, "id long, k string, name string, email string, d string").withColumn("deleted_on", F.col("d").cast("date")).drop("d")


def test_source_merge_and_replay(spark, state):
    batch = spark.createDataFrame([(1, "C1", "New", "n@n.fr"), (2, "C2", "Same", "other@b.fr"), (3, "C4", "Back", ""), (4, "C9", "Fresh", "f@f.fr"), (5, "C9", "Second", "s@s.fr")], "n int, k string, name string, email string")
    go = lambda s, **o: merge.source_merge(s, batch, "k", "n", ["name"], ["email"], "2026-06-30", **o)
    rows = {r.k: r for r in go(state).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {"C1": "updated", "C2": "unchanged", "C3": "archived", "C4": "updated", "C5": "kept", "C9": "inserted"}
    assert (rows["C1"].name, rows["C1"].email, rows["C2"].email, rows["C9"].name) == ("New", "n@n.fr", "a@b.fr", "Fresh")
    assert rows["C4"].revived and rows["C4"].deleted_on is None and str(rows["C3"].deleted_on) == "2026-06-30"
    assert {r.k: r.outcome for r in go(state, archive=False).collect()}["C3"] == "kept"
    again = {r.k: r.outcome for r in go(go(state).drop("outcome", "revived")).collect()}
    assert again == {"C1": "unchanged", "C2": "unchanged", "C3": "kept", "C4": "unchanged", "C5": "kept", "C9": "unchanged"}
    with pytest.raises(ValueError):
        merge.source_merge(state, batch.limit(0), "k", "n", ["name"], [], "2026-06-30")


def test_collected_and_declared(spark):
    now = spark.createDataFrame([(1, "", "01", {"phone": "declared"}), (2, "s", None, None)], "id int, site string, phone string, field_origins map<string,string>")
    new = spark.createDataFrame([(1, "new", "99"), (2, "t", "88")], "id int, site string, phone string")
    rows = {r.id: r for r in merge.fill_collected(now, new, "id", ["site", "phone"]).collect()}
    assert (rows[1].site, rows[1].phone, rows[1].field_origins) == ("new", "01", {"phone": "declared", "site": "collected"})
    assert (rows[2].site, rows[2].phone, rows[2].field_origins) == ("s", "88", {"phone": "collected"})
    rows = {r.id: r for r in merge.write_declared(now, new, "id", ["site"]).collect()}
    assert (rows[2].site, rows[2].field_origins) == ("t", {"site": "declared"})


def test_guards():
    merge.guard_share(100, 30)
    with pytest.raises(merge.BlastRadius):
        merge.guard_share(100, 31)
    with pytest.raises(merge.BlastRadius):
        merge.guard_share(10**6, 1001, attended=False)


def test_stage_fold_depends_on_order(spark):
    rows = [(1, 1, 1, "client"), (1, 2, 2, "qualifie"), (2, 1, 1, "dormant"), (2, 2, 2, "nouveau"), (3, 1, 1, "perdu"), (3, 2, 2, "client"), (4, 2, 1, "opportunite"), (4, 1, 2, "nouveau")]
    df = spark.createDataFrame(rows, "k int, at int, id int, stage string")
    assert {r.k: r.stage for r in merge.fold_stages(df, "k", "at", "id", "stage").collect()} == {1: "client", 2: "qualifie", 3: "perdu", 4: "opportunite"}


def test_chain(spark):
    rows, prev = [], "0" * 64
    for i in range(1, 31):
        payload = hashlib.sha256(str(i).encode()).hexdigest()
        current = hashlib.sha256(f"{prev}|{payload}".encode()).hexdigest()
        rows.append((i, prev, payload, current))
        prev = current
    make = lambda rows: spark.createDataFrame(rows, "id long, prev_hash string, payload_hash string, current_hash string")
    assert merge.verify_chain(make(rows), shard=7).count() == 0
    rows[9] = (*rows[9][:2], "tampered", rows[9][3])
    del rows[19]
    bad = {r.id: (r.link_ok, r.hash_ok) for r in merge.verify_chain(make(rows), shard=7).collect()}
    assert bad == {10: (True, False), 21: (False, True)}


def test_duplicate_census(spark):
    df = spark.createDataFrame([("w1", i, e) for i, e in enumerate(["a@x.fr", "A@X.FR", "a@x.fr", "b@x.fr", "b@x.fr", "c@x.fr", None])] + [("w2", 9, "a@x.fr")], "workspace_id string, id int, email string")
    rows = {r.workspace_id: r for r in rollups.duplicate_census(df).collect()}
    assert tuple(rows["w1"])[1:] == (7, 6, 3, 2, 5, 3) and tuple(rows["w2"])[1:] == (1, 1, 1, 0, 0, 0)


def test_gates_and_pages(spark):
    people = spark.createDataFrame([(1, "A@x.fr"), (2, "b@x.fr"), (3, None)], "id int, email string")
    opposed = spark.createDataFrame([(" a@X.fr", "business"), ("b@x.fr", "vivier")], "email string, scope string")
    kept = relations.not_opposed(people, opposed)
    assert {r.id for r in kept.collect()} == {2, 3}
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(20)], "id int, s int")
    seen, after = [], None
    while True:
        page = relations.keyset_page(rows, "s", 6, after).collect()
        seen += page[:6]
        if len(page) <= 6:
            break
        after = (page[5].s, page[5].id)
    assert [r.id for r in seen] == [r.id for r in sorted(rows.collect(), key=lambda r: (r.s is None, -(r.s or 0), -r.id))]


def test_unique_links(spark):
    companies = spark.createDataFrame([(1, "w1", "1", "Café Noël"), (2, "w1", None, "Twin"), (3, "w1", None, "TWIN"), (4, "w2", None, "Other")], "id long, workspace_id string, siren string, denomination string")
    media = spark.createDataFrame([("w1", None, "cafe  noel"), ("w1", "1", "x"), ("w1", None, "twin"), ("w1", None, "other")], "workspace_id string, siren string, name string")
    assert {r.name: (r.company_id, r.linked_by) for r in relations.link_unique_name(media, companies, "name").collect()} == {"cafe  noel": (1, "name"), "x": (1, "siren"), "twin": (None, "none"), "other": (None, "none")}


# --- files and streams


def test_csv_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Identifiant  RPPS,Nom\n1, A \n2,\n")
    rows = files.read_csv_mapped(spark, str(tmp_path / "a.csv"), {"rpps": ["identifiant rpps"], "name": ["nom", "nom d'exercice"], "city": ["ville"]}).collect()
    assert [tuple(r) for r in rows] == [("1", "A", None), ("2", None, None)]


def test_xlsx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Nom</t></si><si><r><t>Ra</t></r><r><t>dio</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>N</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row><row><c r="C3"><v>8</v></c></row></sheetData></worksheet>')
    rows = files.read_xlsx(spark, str(tmp_path / "b.xlsx"), ["Nom", "N", "Missing"]).collect()
    assert [tuple(r) for r in rows] == [("Radio", "7", None), (None, "8", None)]
    assert files.sheet_rows(io.BytesIO((tmp_path / "b.xlsx").read_bytes()).read())[0] == ["Nom", None, "N"]


def test_geojson(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"code":"1","nom":"A","population":10},"geometry":{"type":"Point"}},{"properties":{"code":"2","nom":"B"},"geometry":null}]}')
    assert [r.code for r in files.read_geojson(spark, str(tmp_path / "g.json"), 5).collect()] == ["1"]


def test_export_says_that_it_is_cut(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("n"), F.lit("é").alias("x"))
    files.write_export(df, str(tmp_path / "full"), ["n"], 10)
    files.write_export(df, str(tmp_path / "cut"), ["n"], 4)
    read = lambda p: next((tmp_path / p).glob("part-*")).read_bytes().decode()
    assert read("full").startswith("﻿n,x") and "TRUNCATED" not in read("full") and len(read("full").splitlines()) == 11
    assert read("cut").splitlines()[1:5] == ["0,é", "1,é", "2,é", "3,é"] and "TRUNCATED AT 4 ROWS" in read("cut").splitlines()[5]


def test_bundle_and_refresh(spark, tmp_path):
    key = "0123456789abcdef"
    row = files.encrypted_bundle(spark.createDataFrame([(1, "x")], "a int, b string"), key)
    assert row.select(F.aes_decrypt(F.unbase64("cipher"), F.lit(key)).cast("string")).first()[0] == '{"a":1,"b":"x"}'
    path = str(tmp_path / "table")
    for n in (3, 5):
        files.refresh_table(spark.range(n), path)
        assert files.read_current(spark, path).count() == n


LINE = '{"schema_version":1,"source":"web","run_id":"%s","status":"success","company":{"siren":"123456789"}}\n'


def test_record_stream_is_idempotent(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    run = lambda: ingest.ingest_records(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    (inbox / "1.jsonl").write_text(LINE % "a" + "\n" + LINE % "a" + LINE % "b" + '{"x":1}\n')
    run()
    (inbox / "2.jsonl").write_text(LINE % "b" + LINE % "c" + "not json\n")
    run()
    run()
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    assert sorted("unknown_key" in r.errors for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [False, True]


def test_event_contract(spark):
    good = '{"schema_version":1,"event_id":"e","event_type":"t","subject_ref":"s","occurred_at":"2026-01-01T00:00:00Z"}'
    lines = spark.createDataFrame([(good,), (good.replace('"s"', "null"),), (good.replace("2026-01-01T00:00:00Z", "soon"),), (good.replace("{", '{"odd":1,'),)], "value string")
    assert [r.errors for r in files.parse_events(lines).collect()] == [[], ["incomplete"], ["occurred_at"], ["unknown_key"]]


def test_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:05:00"), (3, "2024-01-05 00:00:00")]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(src)
    out = ingest.run_to_table(ingest.sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(src)), spark, str(tmp_path / "run"))
    assert sorted((r.user_id, r.n) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_plans_push_down(spark):
    from prospecta.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    plan = relations.not_opposed(v.contacts, v.opt_out)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan
    scan = v.scoped("w1").companies.select("id").where("id < 10")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(c_custkey,10)" in scan and "c_name" not in scan
