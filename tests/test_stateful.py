"""Keyed streaming state: any split into batches, stops in the middle, and keys that go."""

import datetime
import random

from pyspark.sql import functions as F

from prospecta.streaming import monitor, stateful

T0 = datetime.datetime(2024, 1, 1)
MESSAGE = "run_id string, kind string, source string, payload string, at timestamp"


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


def tick(spark, schema, at=10**6, **values):
    names = [f.split()[0] for f in schema.split(", ")]
    row = {"kind": stateful.TICK, "at": minutes(at), **values}
    return spark.createDataFrame([tuple(row.get(n, "") for n in names)], schema)


def test_each_message_has_one_final_result(spark, tmp_path):
    rows = [(f"m{i}", "job", "web", str(i % 5), minutes(i)) for i in range(60)]
    rows += [(f"m{i}", "job", "web", str(i % 5), minutes(i)) for i in range(0, 60, 7)]  # sent twice
    rows += [("m4", "cancel", "web", None, minutes(5)), ("gone", "cancel", "web", None, minutes(5)), ("bad", "job", "web", "x", minutes(9)), ("none", "job", None, None, minutes(9))]
    random.Random(1).shuffle(rows)

    def attempt(payload, n):
        return f"no {n}" if n <= int(payload) else None

    progress = []
    for part in (rows[:40], rows[40:], [("m3", "job", "web", "0", minutes(10**5))], None):
        df = spark.createDataFrame(part, MESSAGE) if part else tick(spark, MESSAGE)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(MESSAGE).parquet(f"{tmp_path}/in")
        progress += stateful.run_delivery(stateful.deliver(stream, attempt, backoff=600, late="2 hours"), f"{tmp_path}/out")
    read = spark.read.schema(stateful.RESULT)
    done = {r.run_id: (r.status, r.attempts) for r in read.parquet(f"{tmp_path}/out/done/epoch=*").collect()}
    failed = [(r.run_id, r.attempts, r.error) for r in read.parquet(f"{tmp_path}/out/failed/epoch=*").collect()]
    assert len(failed) == len({f[0] for f in failed}) and not set(done) & {f[0] for f in failed}
    want = {f"m{i}": ("success", i % 5 + 1) for i in range(60) if i % 5 < 3 and i != 4}
    assert done == want
    assert {f[0] for f in failed} == {f"m{i}" for i in range(60) if i % 5 >= 3 and i != 4} | {"bad", "none"}
    assert {f[1] for f in failed} == {3} and dict((f[0], f[2]) for f in failed)["m3"] == "no 3"


def reached(times, threshold, live):
    out, held = [], []
    for t in sorted(set(times)):
        held = [h for h in held if t - h < live]
        before = min(len(held), threshold)
        held = (held + [t] * times.count(t))[-threshold:]
        if len(held) >= threshold > before:
            out.append(t)
    return out


def test_threshold_within_a_time_to_live(spark, tmp_path):
    schema = "key string, kind string, at timestamp"
    rng = random.Random(3)
    events = {k: sorted(rng.randrange(60 * 24 * 60) for _ in range(rng.randrange(1, 14))) for k in "abcdefgh"}
    events["hot"] = [5] * 50 + [3 * 24 * 60 + 4] * 2
    rows = [(k, "bounce", minutes(m)) for k, ms in events.items() for m in ms]
    progress = []
    for n, cut in enumerate((range(0, 20 * 24 * 60), range(20 * 24 * 60, 10**7), None, None)):
        part = [r for r in rows if (r[2] - T0).total_seconds() / 60 in cut] if cut else None
        if part:
            rng.shuffle(part)
        df = spark.createDataFrame(part, schema) if part else tick(spark, schema, 10**6 * n)
        df.coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        progress += stateful.run_to_epochs(stateful.threshold_reached(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3, 3), f"{tmp_path}/out")
    got = sorted((r.key, int((r.at - T0).total_seconds() // 60)) for r in spark.read.parquet(f"{tmp_path}/out/epoch=*").collect())
    assert got == sorted((k, t) for k, ms in events.items() for t in reached(ms, 3, 3 * 24 * 60)) and len(got) >= 3
    alive = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert max(alive) > 0 and alive[-1] == 0  # every key is gone in the end


def stage_after(events):
    stage = ""
    for *_, new in sorted(events):
        rank = stateful.STAGE_RANK.get
        if stage in ("", "perdu"):
            stage = stage or new
        elif stage == "dormant":
            stage = "qualifie" if new == "nouveau" else new
        elif rank(new, 0) > rank(stage, 0):
            stage = new
    return stage


def test_stages_in_any_split(spark, tmp_path):
    schema = "subject long, at timestamp, event_id long, stage string"
    rng = random.Random(9)
    kinds = ["nouveau", "qualifie", "dormant", "dormant", "", None, "opportunite", "client", "perdu"]
    rows = [(s, minutes(rng.randrange(40)), i, rng.choice(kinds[: 6 if s % 2 else 9])) for i in range(400) for s in [rng.randrange(60)]]
    for part in range(3):  # at random: late events in each
        spark.createDataFrame([r for i, r in enumerate(rows) if i % 3 == part], schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stateful.run_to_epochs(stateful.fold_stages_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", "update")
    got = {r.subject: r.stage for r in stateful.latest(spark.read.parquet(f"{tmp_path}/out"), "subject", "stage").collect()}
    assert got == {s: stage_after([(r[1], r[2], r[3] or "") for r in rows if r[0] == s]) for s in {r[0] for r in rows}}


def test_monitor_writes_progress_for_each_trigger(spark, tmp_path):
    schema = "campaign_id long, company_id long, status string, started_at timestamp, finished_at timestamp"
    parts = [[(1, 7, "success", minutes(0), minutes(1)), (1, 8, "queued", minutes(0), None), (2, None, "failed", minutes(9), minutes(3))], [(1, 7, "failed", minutes(2), minutes(4)), (3, 1, "success", minutes(0), minutes(600))]]
    counted = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        rows = monitor.watch(stream, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", 10, 3600, every="1 second", triggers=1)
        counted += [r for r in rows.collect() if r.rows]
    assert all(r.millis >= 0 for r in counted) and sum(r.rows for r in counted) in (0, 2, 3, 5)  # the listener is told later than the sink
    read = lambda n: {r.campaign_id: (r.runs_total, r.runs_completed, r.seconds_used, r.companies, r.status) for r in spark.read.parquet(f"{tmp_path}/out/epoch={n}").collect()}
    assert read(0) == {1: (2, 1, 60, 2, "running"), 2: (1, 1, 0, 0, "completed")}
    assert read(1) == {1: (3, 2, 180, 2, "running"), 2: (1, 1, 0, 0, "completed"), 3: (1, 1, 36000, 1, "paused")}
    assert spark.read.parquet(f"{tmp_path}/out").select(F.count_distinct("epoch")).first()[0] == 2
