"""Stored tables changed in part: what is touched, what is not, and equality with doing it all again."""

import datetime
import ipaddress
import os
import random

from pyspark.sql import functions as F

from prospecta.operators import networks, picks, rollups, tables
from prospecta.sources import pages


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith((".parquet", ".json"))}


def test_upsert_writes_what_it_touches_and_keeps_the_state_in_place(spark, tmp_path):
    old = spark.range(2000).selectExpr("id", "'old' AS name", "id AS score")
    tables.create_keyed(old, "upsert_test", "id", f"{tmp_path}/t", parts=16, buckets=4)
    before = files(f"{tmp_path}/t")
    batch = spark.createDataFrame([(5, None, 50), (7, "new", None), (9_000_000, "more", 1)], "id long, name string, score long")
    merge = lambda c, was, comes: F.coalesce(comes, was)
    plan = tables.upsert_plan(spark, "upsert_test", batch, "id", merge, 16)._jdf.queryExecution().executedPlan().toString()
    scan = next(i for i, line in enumerate(plan.split("\n")) if "FileScan" in line)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert all("Exchange" not in line for line in plan.split("\n")[scan - 3 : scan])  # the one is on the batch's side
    tables.upsert(spark, "upsert_test", batch, "id", merge, 16)
    got = {r.id: (r.name, r.score) for r in spark.table("upsert_test").collect()}
    assert len(got) == 2001 and got[5] == ("old", 50) and got[7] == ("new", 7) and got[9_000_000] == ("more", 1) and got[6] == ("old", 6)
    after = files(f"{tmp_path}/t")
    folder = lambda f: os.path.basename(os.path.dirname(f))
    changed = {folder(f) for f in before - after}
    assert 1 <= len(changed) <= 3 and {folder(f) for f in after - before} >= changed  # the others keep their files
    spark.sql("DROP TABLE upsert_test")


def test_repair_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.range(10, 1010).selectExpr("id", "id AS x")
    calls = []

    def repair(df):
        calls.append(1)
        return df.withColumn("x", F.col("x") + 1)

    assert tables.repair_ranges(rows, "id", 300, repair, str(tmp_path), most=1) == 3
    # a range whose rows were written but not its line is done again, once
    repair(rows.where("id BETWEEN 310 AND 609")).write.parquet(f"{tmp_path}/rows/range=1")

    def breaks(df):
        if df.agg(F.min("id")).first()[0] == 610:
            raise RuntimeError("stopped")
        return repair(df)

    try:
        tables.repair_ranges(rows, "id", 300, breaks, str(tmp_path))
    except RuntimeError:
        pass
    assert tables.repair_ranges(rows, "id", 77, repair, str(tmp_path)) == 0  # the first run's cut holds
    got = sorted((r.id, r.x) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert got == [(i, i + 1) for i in range(10, 1010)]
    done = len(calls)
    assert tables.repair_ranges(rows, "id", 300, repair, str(tmp_path)) == 0 and len(calls) == done
    assert tables.repair_ranges(rows.where("id < 0"), "id", 300, repair, f"{tmp_path}/none") == 0


def test_coverage_by_deltas_equals_counting_again(spark, tmp_path):
    rng = random.Random(4)
    schema = "id long, workspace_id string, postcode string, naf string, size_category string, quality_score int, enriched_on date"

    def company(i):
        day = rng.choice([None, datetime.date(2026, 1, rng.randrange(1, 9))])
        return (i, rng.choice("wx"), rng.choice(["38000", "69001", None]), rng.choice(["6201Z", None]), rng.choice(["PME", None]), rng.choice([40, 60, 95]), day)

    now = {i: company(i) for i in range(150)}
    frame = lambda rows: spark.createDataFrame(list(rows), schema)
    stored = rollups.coverage_matrix(frame(now.values()))
    for step in range(3):
        picked = rng.sample(sorted(now), 40)
        before = [now[i] for i in picked]
        after = [company(i) for i in picked[:30]] + [company(1000 * (step + 1) + k) for k in range(15)]
        for i in picked:
            del now[i]
        now |= {r[0]: r for r in after}
        tables.coverage_after(stored, frame(before), frame(after), frame(now.values())).write.parquet(f"{tmp_path}/{step}")
        stored = spark.read.parquet(f"{tmp_path}/{step}")
        columns = [*tables.CELL, "total", "complete", "partial", "last_enriched", "department"]
        want = rollups.coverage_matrix(frame(now.values())).select(*columns)
        assert sorted(map(str, stored.select(*columns).collect())) == sorted(map(str, want.collect()))


def test_postings_equal_the_scan_and_read_few_folders(spark, tmp_path):
    rng = random.Random(6)
    names = [f"{rng.choice(['Café', 'Société de la', 'ACME', 'L’Étoile'])} {rng.choice(['Noël', 'Forge', 'Tech', '100%', ''])} {i}" for i in range(400)] + [None, "", "ab"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    tables.write_postings(rows, "id", "name", str(tmp_path))
    from prospecta.functions.text import normalize_name

    plain = {r.id: r.n for r in rows.select("id", normalize_name(F.col("name")).alias("n")).collect()}
    for terms in (["Café Noël"], ["forge 1", "100%"], ["ab"], ["zzz unknown"], ["", "tech"], ["É"]):
        wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(normalize_name(F.col("t"))).collect()]
        assert sorted(r.id for r in tables.search_postings(spark, str(tmp_path), terms).collect()) == sorted(i for i, n in plain.items() if any(w and w in n for w in wanted)), terms
    plan = tables.search_postings(spark, str(tmp_path), ["Café Noël"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert len([f for f in tables.search_postings(spark, str(tmp_path), ["Café Noël"]).inputFiles()]) > 0


def test_networks_of_both_families(spark):
    rng = random.Random(8)
    v4 = [f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)]
    v6 = [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, 0xFFFF << 112 | 0xFF]))) for _ in range(200)] + ["::1", "::", "fc00::5", "FE80::1", "1:2:3:4:5:6:7:8"]
    odd = ["1.2.3", "256.1.1.1", "", "x", "1::2::3", ":::", "1:2:3", "12345::", None]
    nets = [f"{v4[i]}/{rng.randrange(4, 33)}" for i in range(40)] + [f"{v6[i]}/{rng.randrange(8, 129)}" for i in range(40)] + ["fc00::/7", "::1/128", "0.0.0.0/8"]
    parsed = [ipaddress.ip_network(n, strict=False) for n in nets]
    denied = lambda ip: any(ipaddress.ip_address(ip) in n for n in parsed)
    asked = [*v4, *v6, *odd, v4[0], v4[0]]
    df = spark.createDataFrame(list(enumerate(asked)), "id long, ip string")
    out = networks.in_networks(df, "ip", spark.createDataFrame([(n,) for n in [*nets, "bad/8", "1.2.3.4/99"]], "net string"), "net")
    got = {r.id: r.denied for r in out.collect()}
    assert got == {i: True if ip in odd else denied(ip) for i, ip in enumerate(asked)}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_picks_are_repeatable_and_fair(spark):
    choices = spark.createDataFrame([("a", 1), ("b", 3), ("c", 0), ("d", 6), ("e", -2)], "name string, w int")
    rows = spark.range(20_000)
    one = picks.weighted_pick(rows, "id", choices, "name", "w", 3)
    assert one.count() == 20_000
    got = {r["pick"]: r["count"] for r in one.groupBy("pick").count().collect()}
    assert set(got) == {"a", "b", "d"} and all(abs(got[k] - 2000 * w) < 300 for k, w in (("a", 1), ("b", 3), ("d", 6)))
    again = picks.weighted_pick(rows.repartition(7), "id", choices.repartition(2), "name", "w", 3)
    assert one.join(again.withColumnRenamed("pick", "p"), "id").where("pick <> p").count() == 0
    assert picks.weighted_pick(rows.limit(3), "id", choices.where("w < 0"), "name", "w").where("pick IS NULL").count() == 3


def test_pages_are_chosen_by_filters(spark, tmp_path):
    rows = spark.range(600).selectExpr("id", "concat(lpad(id % 7 + 60, 2, '0'), lpad(id % 3, 2, '0'), 'Z') AS naf", "CASE WHEN id % 5 = 0 THEN NULL ELSE cast(id % 4 AS string) END AS staff", "CASE WHEN id % 11 = 0 THEN NULL ELSE cast(38 + id % 3 AS string) END AS dep")
    pages.land_pages(rows, f"{tmp_path}/p", "id", "dep", "naf", 10)
    some = pages.read_pages(spark, f"{tmp_path}/p", rows.schema, ["38", "40"], "62", ("staff", ["1", "2"]))
    want = rows.where("dep IN ('38', '40') AND naf LIKE '62%' AND staff IN ('1', '2')")
    assert sorted(map(str, some.collect())) == sorted(map(str, want.collect())) and some.count() > 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [page_department" in plan or "page_department#" in plan[plan.index("PartitionFilters") :]
    assert pages.read_pages(spark, f"{tmp_path}/p", rows.schema).count() == 600
