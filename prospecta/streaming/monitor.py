"""Campaign progress by the clock: a trigger each minute, a row of progress for each campaign and for each trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVERY = "60 seconds"


class Progress(StreamingQueryListener):
    """Rows (query, epoch, rows, millis) of each trigger that ran, for ``table``; times below zero count as zero."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.id), int(p.batchId), max(0, int(p.numInputRows)), max(0, int(p.durationMs.get("triggerExecution", 0)))))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, epoch long, rows long, millis long")


def progress_of(runs: DataFrame) -> DataFrame:
    """A campaign's finished runs, distinct companies and used seconds; a run that ends before it begins uses none."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"))
    return runs.groupBy("campaign_id").agg(
        F.count("*").alias("runs_total"), F.count_if(F.col("status").isin("success", "failed", "partial", "cancelled")).alias("runs_completed"),
        F.coalesce(F.sum(seconds), F.lit(0)).alias("seconds_used"), F.count_distinct("company_id").alias("companies"))


def next_status(progress: DataFrame, most_companies: int, most_seconds: int) -> DataFrame:
    """``progress`` with the campaign's ``status`` and ``paused_reason``: a limit that is reached pauses, all runs done completes."""
    reason = F.when(F.col("companies") >= most_companies, "max_companies").when(F.col("seconds_used") >= most_seconds, "max_duration")
    done = (F.col("runs_total") > 0) & (F.col("runs_completed") >= F.col("runs_total"))
    return progress.withColumn("paused_reason", reason).withColumn("status", F.when(F.col("paused_reason").isNotNull(), "paused").when(done, "completed").otherwise("running"))


def watch(stream: DataFrame, landed: str, out: str, checkpoint: str, most_companies: int, most_seconds: int, every: str = EVERY, triggers: int | None = None) -> DataFrame:
    """Write each campaign's progress at each trigger that finds new runs, to ``out/epoch=n``; the triggers' own rows are returned.

    The counts are of all runs in ``landed``, the folder that ``stream`` reads, at that time, and never go back: a
    campaign's companies are the greater of what was written before and now.  With ``triggers``
    the run ends after so many that had runs; otherwise it goes on until it is stopped.
    """
    spark = stream.sparkSession
    listener = Progress()
    seen = 0

    def save(batch: DataFrame, epoch: int) -> None:
        nonlocal seen
        now = progress_of(spark.read.schema(batch.schema).parquet(landed))
        if epoch:
            past = spark.read.parquet(f"{out}/epoch={epoch - 1}").select("campaign_id", F.col("companies").alias("_past"))
            now = now.join(past, "campaign_id", "left").withColumn("companies", F.greatest("companies", F.coalesce("_past", F.lit(0)))).drop("_past")
        next_status(now, most_companies, most_seconds).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        seen += 1

    spark.streams.addListener(listener)
    try:
        query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
        while query.isActive and (triggers is None or seen < triggers):
            query.awaitTermination(1)
        query.processAllAvailable()
        query.stop()
    finally:
        spark.streams.removeListener(listener)
    return listener.table(spark)
