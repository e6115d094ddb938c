"""Queries of keyed streaming state: each lands the table in two parts and is stopped between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming import ingest, monitor, stateful
from .feeds import scratch
from .registry import query

#: What is before this day is landed first.
_CUT = "2024-01-16"
#: A row of this time comes last and lets every timer go.
_END = "2034-01-01"


def _time(c: Column | str) -> Column:
    return F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp")


def _before() -> Column:
    return F.col("at") < F.lit(_CUT).cast("timestamp")


def _reader(v, folder: str, schema) -> DataFrame:
    return v.spark.readStream.schema(schema).parquet(folder)


def fails_as_told(payload: str, attempt: int) -> str | None:
    """A stand-in for a scraper: the payload says how many tries fail."""
    return f"try {attempt} failed" if attempt <= int(payload) else None


@query("st_delivery", "SELECT 'r' || event_id::VARCHAR AS run_id, event_type AS source, CASE WHEN user_id % 5 >= 3 THEN 'failed' ELSE 'success' END AS status, CAST(least(user_id % 5 + 1, 3) AS INT) AS attempts, CASE WHEN user_id % 5 >= 3 THEN 'try 3 failed' END AS error FROM events WHERE event_id % 29 <> 0")
def delivery(v):
    """Messages with 0 to 4 failing tries, some cancelled, some sent again, over a restart: one final result each."""
    folder = scratch(v.spark)
    jobs = v.events.select(F.concat(F.lit("r"), "event_id").alias("run_id"), F.lit("job").alias("kind"), F.col("event_type").alias("source"), (F.col("user_id") % 5).cast("string").alias("payload"), _time("ts").alias("at"))
    number = F.expr("cast(substr(run_id, 2) AS long)")
    cancels = jobs.where(number % 29 == 0).withColumn("kind", F.lit("cancel"))
    again = jobs.where(number % 7 == 0).withColumn("at", F.col("at") + F.expr("INTERVAL 40 DAYS"))
    tick = v.spark.range(1).select(F.lit("").alias("run_id"), F.lit(stateful.TICK).alias("kind"), F.lit("").alias("source"), F.lit("").alias("payload"), F.lit(_END).cast("timestamp").alias("at"))
    both = jobs.unionByName(cancels)
    for part in (both.where(_before()), both.where(~_before()).unionByName(again), tick):
        part.write.mode("append").parquet(f"{folder}/messages")
        stateful.run_delivery(stateful.deliver(_reader(v, f"{folder}/messages", jobs.schema), fails_as_told), f"{folder}/results")
    read = v.spark.read.schema(stateful.RESULT)
    return read.parquet(f"{folder}/results/done/epoch=*").unionByName(read.parquet(f"{folder}/results/failed/epoch=*"))


#: The tables span a month, the real time to live; of it a sixth here, so that events do expire.
_LIVE = 5


@query(
    "st_soft_bounces",
    f"""SELECT DISTINCT email_hash, "at" FROM (SELECT email_hash, "at", count(*) OVER (PARTITION BY email_hash ORDER BY "at" RANGE BETWEEN INTERVAL '{_LIVE - 1} days 23:59:59.999' PRECEDING AND CURRENT ROW) AS n,
count(*) OVER (PARTITION BY email_hash ORDER BY "at" RANGE BETWEEN INTERVAL '{_LIVE - 1} days 23:59:59.999' PRECEDING AND INTERVAL '0.001 seconds' PRECEDING) AS earlier
FROM (SELECT user_id::VARCHAR AS email_hash, date_trunc('milliseconds', ts) AS "at" FROM events WHERE event_type = 'error')) WHERE n >= 3 AND earlier < 3""",
)
def bounces(v):
    """When an address comes to three soft bounces within the time to live; later falls below it count anew."""
    folder = scratch(v.spark)
    events = v.events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("key"), F.lit("bounce").alias("kind"), _time("ts").alias("at"))
    tick = v.spark.range(1).select(F.lit("").alias("key"), F.lit(stateful.TICK).alias("kind"), F.lit(_END).cast("timestamp").alias("at"))
    for part in (events.where(_before()), events.where(~_before()), tick):
        part.write.mode("append").parquet(f"{folder}/events")
        stateful.run_to_epochs(stateful.threshold_reached(_reader(v, f"{folder}/events", events.schema), 3, _LIVE), f"{folder}/table")
    return v.spark.read.schema("key string, at timestamp, n int").parquet(f"{folder}/table/epoch=*").select(F.col("key").alias("email_hash"), F.col("at").cast("timestamp_ntz").alias("at"))


def _rank(x: str) -> str:
    return f"coalesce(list_position(['qualifie', 'opportunite', 'client'], {x}), 0)"


#: The steps of a stage, one event after the other.
FOLD_SQL = f"""SELECT user_id, list_reduce(list_prepend('', list(stage ORDER BY ts, event_id)), lambda cur, inc: CASE WHEN cur = '' THEN inc WHEN cur = 'perdu' THEN cur WHEN cur = 'dormant' THEN CASE inc WHEN 'nouveau' THEN 'qualifie' ELSE inc END
WHEN {_rank("inc")} > {_rank("cur")} THEN inc ELSE cur END) AS stage FROM (SELECT *, ['nouveau', 'qualifie', 'dormant', 'client', 'opportunite', 'qualifie', 'perdu'][event_id % 7 + 1] AS stage FROM events) GROUP BY user_id"""


@query("st_stage_fold", FOLD_SQL)
def stages(v):
    """Every second event comes late, in a second run."""
    folder = scratch(v.spark)
    stage = F.element_at(F.array(*map(F.lit, ("nouveau", "qualifie", "dormant", "client", "opportunite", "qualifie", "perdu"))), (F.col("event_id") % 7 + 1).cast("int"))
    events = v.events.select(F.col("user_id").alias("subject"), _time("ts").alias("at"), "event_id", stage.alias("stage"))
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/events")
        stateful.run_to_epochs(stateful.fold_stages_stream(_reader(v, f"{folder}/events", events.schema)), f"{folder}/table", "update")
    return stateful.latest(v.spark.read.parquet(f"{folder}/table"), "subject", "stage").select(F.col("subject").alias("user_id"), "stage")


@query("st_distinct_events", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def distinct(v):
    """A third of the events comes twice, the second time a minute later and in a later run."""
    folder = scratch(v.spark)
    events = v.events.select("event_id", "event_type", _time("ts").alias("ts"))
    again = events.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
    for part in (events, again):
        part.write.mode("append").parquet(f"{folder}/events")
        stateful.run_to_epochs(ingest.distinct_events(_reader(v, f"{folder}/events", events.schema), late="60 days"), f"{folder}/table")
    return v.spark.read.schema(events.schema).parquet(f"{folder}/table/epoch=*").groupBy("event_type").agg(F.count("*").alias("n"))


_RUNS = "runs_total, runs_completed, seconds_used, companies, paused_reason, status"


@query(
    "st_campaign_monitor",
    """SELECT *, CASE WHEN paused_reason IS NOT NULL THEN 'paused' WHEN runs_completed >= runs_total THEN 'completed' ELSE 'running' END AS status FROM (SELECT *, CASE WHEN companies >= 140 THEN 'max_companies' WHEN seconds_used >= 1000 THEN 'max_duration' END AS paused_reason FROM (
SELECT event_id % 6 AS campaign_id, count(*) AS runs_total, count(*) FILTER (event_type IN ('error', 'purchase', 'view')) AS runs_completed, CAST(sum(greatest(0, epoch(date_trunc('second', ts + to_milliseconds(CAST(floor(value * 10) - 500 AS BIGINT)))) - epoch(date_trunc('second', ts)))) AS BIGINT) AS seconds_used,
count(DISTINCT CASE WHEN event_id % 12 <> 0 THEN user_id END) AS companies FROM events GROUP BY 1))""",
)
def campaigns(v):
    """Two triggers with a restart between them; runs that end before they begin are among them."""
    folder = scratch(v.spark)
    ended = F.timestamp_micros(F.unix_micros(_time("started_at")) + F.col("latency_ms") * 1000)
    runs = v.runs.select("id", "campaign_id", "company_id", "status", _time("started_at").alias("started_at"), ended.alias("finished_at"))
    for part in (0, 1):
        runs.where(F.col("id") % 2 == part).drop("id").write.mode("append").parquet(f"{folder}/runs")
        stream = _reader(v, f"{folder}/runs", runs.drop("id").schema)
        monitor.watch(stream, f"{folder}/runs", f"{folder}/progress", f"{folder}/checkpoint", 140, 1000, every="1 second", triggers=1)
    return v.spark.read.parquet(f"{folder}/progress/epoch=1").select("campaign_id", *_RUNS.split(", "))
