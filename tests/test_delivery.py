"""Deliveries in buckets: many messages share a key's state, cancels and copies come in any batch."""

import datetime

from prospecta.streaming import stateful

T0 = datetime.datetime(2024, 1, 1)
MESSAGE = "run_id string, kind string, source string, payload string, at timestamp"


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


def test_messages_of_one_bucket_go_their_own_ways(spark, tmp_path):
    def attempt(payload, n):
        return f"{payload} {n}" if n <= int(payload) else None

    def job(run_id, payload, at):
        return (run_id, "job", "web", payload, minutes(at))

    def cancel(run_id, at):
        return (run_id, "cancel", "web", None, minutes(at))

    tick = ("", stateful.TICK, "", "", minutes(10**6))
    parts = [
        [job(f"m{i}", str(i % 4), i % 50) for i in range(2000)] + [job("copy", "3", 2), job("copy", "0", 1), job("copy", "1", 1), cancel("early", 1), cancel("both", 1), job("both", "0", 1), job("stop", "2", 49)],
        [job("early", "0", 50), cancel("stop", 51), cancel("m0", 51), job("m1", "0", 52), job("copy", "3", 52)],  # m0 is done, m1 waits
        [tick],
    ]
    progress = []
    for part in parts:
        spark.createDataFrame(part, MESSAGE).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.deliver(spark.readStream.schema(MESSAGE).parquet(f"{tmp_path}/in"), attempt, buckets=4)
        progress += stateful.run_delivery(stream, f"{tmp_path}/out")
    read = spark.read.schema(stateful.RESULT)
    got = [tuple(r) for kind in ("done", "failed") for r in read.parquet(f"{tmp_path}/out/{kind}/epoch=*").collect()]
    want = [(f"m{i}", "web", "failed" if i % 4 == 3 else "success", min(i % 4 + 1, 3), "3 3" if i % 4 == 3 else None) for i in range(2000)]
    assert sorted(got, key=str) == sorted([*want, ("copy", "web", "success", 1, None)], key=str)
    held = [o["numRowsTotal"] for p in progress for o in p["stateOperators"] if "transformWithState" in o["operatorName"]]
    assert 0 < max(held) <= 4 * 2 + 4 * 2  # values and timers of four buckets, not of each message
