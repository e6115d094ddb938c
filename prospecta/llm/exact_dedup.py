"""Exact deduplication as a stateful stream.

``stream_state`` runs two Structured Streaming queries over what is there.  The first one
normalises and digests each text once and appends a record for each row: digest, doc_id and
the content's locator (file and row).  The second one aggregates the records in keyed state
that lives in RocksDB on the executors' disks, is checkpointed to the shared folder and never
expires (no watermark): per digest the stable identifier (smallest doc_id), the locator of
that document's content and the number of documents.
The full bytes of all hits (rows of a digest that several have) are then fetched by their
locators and compared: the least and the greatest text of a digest must be one.  Documents of
a digest with different bytes (a collision) are grouped again by their bytes.  Only DataFrame
operations run; of a frequent digest each task keeps one least and one greatest text.

A document's text is compared after each run of ASCII white space is made one space;
null counts as empty.  The row with the smallest doc_id stays.  Null doc_ids come after
all others.  ``decisions`` decides by doc_id, so that all rows of one id and text get
``kept``; ``deduplicate`` decides by row (file and row of the staged input): exactly one
row of each text stays, whatever ids are null or repeated.  Empty inputs give no rows.
Other columns pass through ``deduplicate`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_REGEX, materialize, scratch_path

#: Sorts null doc_ids last.
_LAST = 2**63 - 1
RECORDS = "digest binary, sha binary, id long, file string, row long"
STATE = "digest binary, keep_id long, file string, row long, group_size long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_REGEX, " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet file or folder at ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    head, _, tail = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{head}/[{tail[0]}]{tail[1:]}")  # as a pattern, a single file is taken too


def locator() -> list[Column]:
    """File and row of a row that is read from Parquet."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def stream_records(stream: DataFrame, digest=sha256_digest, checkpoint: str | None = None) -> DataFrame:
    """Append a record for each new row of the stream and return all of them: RECORDS rows."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    rows = stream.select(normalised(F.col("text")).alias("text"), F.coalesce("doc_id", F.lit(_LAST)).alias("id"), *locator())
    records = rows.select(digest(F.col("text")).alias("digest"), sha256_digest(F.col("text")).alias("sha"), "id", "file", "row")
    query = records.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{checkpoint}/records-log").option("path", f"{checkpoint}/records").start()
    query.awaitTermination()
    return spark.read.schema(RECORDS).parquet(f"{checkpoint}/records")


def stream_state(stream: DataFrame, digest=sha256_digest, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over all that is there and return the state: STATE rows, one per digest.

    With the same ``checkpoint`` a later call takes only new files and updates the state.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    stream_records(stream, digest, checkpoint)
    changes = f"{checkpoint}/changes"
    records = spark.readStream.schema(RECORDS).parquet(f"{checkpoint}/records")
    state = records.groupBy("digest").agg(F.min(F.struct("id", "file", "row")).alias("first"), F.count("*").alias("group_size"))

    def save(batch: DataFrame, epoch: int) -> None:
        batch.select("digest", F.col("first.id").alias("keep_id"), "first.file", "first.row", "group_size").write.mode("overwrite").parquet(f"{changes}/epoch={epoch}")

    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each state partition takes megabytes ahead
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(save).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not query.lastProgress:  # nothing was there
        return spark.createDataFrame([], STATE)
    saved = spark.read.schema(STATE + ", epoch long").parquet(changes)
    # ids only fall and counts only rise, so the latest of each is also the extreme
    return saved.groupBy("digest").agg(F.min(F.struct("keep_id", "file", "row")).alias("first"), F.max("group_size").alias("group_size")).select("digest", "first.*", "group_size")


def groups_of(records: DataFrame, state: DataFrame, texts: DataFrame) -> DataFrame:
    """id, file, row, sha, and its group's keep_id, keep_file, keep_row, group_size, for each of ``records``.

    ``texts`` has file, row and text of all records.  Every join is one sort-merge join between
    two shuffles, which Spark can split where a digest is frequent.
    """
    state = materialize(state, "state")
    first = state.select("digest", "keep_id", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), "group_size")
    found = records.join(first, "digest")
    hits = records.join(state.where("group_size > 1").select("digest"), "digest").select("file", "row", "digest", "id", "sha")
    hits = texts.join(hits, ["file", "row"]).withColumn("text", normalised(F.col("text")))
    extremes = hits.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    apart = materialize(extremes.where("least != greatest").select("digest"), "collisions")
    out = ["id", "file", "row", "sha", "keep_id", "keep_file", "keep_row", "group_size"]
    if apart.isEmpty():
        return found.select(*out)
    # digests collided: their rows are grouped by their bytes
    rows = hits.join(apart, "digest", "left_semi")
    groups = rows.groupBy("text").agg(F.min(F.struct("id", "file", "row")).alias("first"), F.count("*").alias("group_size"))
    groups = groups.select("text", F.col("first.id").alias("keep_id"), F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row"), "group_size")
    return found.join(apart, "digest", "left_anti").select(*out).unionByName(rows.join(groups, "text").select(*out))


def decided(spark: SparkSession, path: str, schema, digest) -> DataFrame:
    """``groups_of`` for the rows in the Parquet file or folder at ``path``, streamed through the state."""
    checkpoint = scratch_path(spark, "dedup-state")
    state = stream_state(read_stream(spark, path, schema), digest, checkpoint)
    records = spark.read.schema(RECORDS).parquet(f"{checkpoint}/records")
    return groups_of(records, state, spark.read.schema(schema).parquet(path).select(*locator(), "text"))


def decisions(spark: SparkSession, path: str, digest=sha256_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of the documents in the Parquet file or folder at ``path``."""
    groups = decided(spark, path, spark.read.parquet(path).schema, digest)
    real = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return groups.select(real("id").alias("doc_id"), real("keep_id").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "dedup-input")
    docs.write.parquet(path)
    groups = decided(spark, path, docs.schema, digest)
    gone = groups.where("file != keep_file or row != keep_row").select("file", "row")
    staged = spark.read.schema(docs.schema).parquet(path).select(F.struct("*").alias("own"), *locator())
    return staged.join(gone, ["file", "row"], "left_anti").select("own.*")
