"""Queries over all rows of their tables, held against Python."""

import random

from pyspark.sql import functions as F

from prospecta.operators import merge
from prospecta.plans import catalog

SF = "/root/testdata/sf0.001"


def step(a, b):
    rank = lambda s: merge.STAGE_RANK.get(s, 0)
    if not a or a == "perdu":
        return a or b
    if a == "dormant":
        return "qualifie" if b == "nouveau" else b
    return b if rank(b) > rank(a) else a


def folded(rows):
    out = {}
    for k, _, _, s in sorted(rows, key=lambda r: r[1:3]):
        out[k] = step(out.get(k), s)
    return out


def test_stage_fold_of_any_order(spark):
    rng = random.Random(2)
    stages = ["nouveau", "qualifie", "dormant", "client", "opportunite", "perdu", "other", None, ""]
    rows = [(k or None, rng.randrange(4), i, rng.choice(rng.choices(stages, k=3))) for i, k in enumerate(rng.randrange(300) for _ in range(1500))]
    df = spark.createDataFrame(rows, "k int, at int, id int, stage string")
    assert {r.k: r.stage for r in merge.fold_stages(df, "k", "at", "id", "stage").collect()} == folded(rows)


def test_stage_fold_takes_all_users(spark, tmp_path):
    stages = ("nouveau", "qualifie", "dormant", "client", "opportunite", "qualifie", "perdu")
    table = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") + 195)
    table.write.parquet(str(tmp_path / "events.parquet"))
    events = table.select("user_id", "ts", "event_id").collect()
    rows = [(r.user_id, r.ts, r.event_id, stages[r.event_id % 7]) for r in events]
    assert {r.user_id: r.stage for r in catalog.queries()["m04_stage_fold"](spark, str(tmp_path)).collect()} == folded(rows)
