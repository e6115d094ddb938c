"""Keyed streaming state with timers: delivery with retries, counters with a time to live, stages folded in any order.

Timers go by event time, so a run over what is there ends, gives the same rows each time and
can be stopped and started between any two micro-batches.  State lives in RocksDB on the
executors and in the checkpoint; every key that is done with goes, or keeps one flag.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import STAGE_RANK
from .ingest import ROCKSDB

#: Attempts at a message, the last one's failure being final.
MOST_ATTEMPTS = 3
#: Rows of this kind carry nothing but time.
TICK = "tick"
_IDLE = ("", "dormant")


def with_rocksdb(spark: SparkSession, run: Callable[[], None]) -> None:
    """``run()`` with state on the executors' disks."""
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        run()
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)


def run_to_epochs(stream: DataFrame, folder: str, mode: str = "append", checkpoint: str | None = None) -> list[dict]:
    """Take all that is there; each micro-batch writes ``folder/epoch=n`` whole, so one that is tried again replaces its rows. The progress of each."""
    progress: list[dict] = []

    def run() -> None:
        save = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint or f"{folder}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        progress.extend(query.recentProgress)

    with_rocksdb(stream.sparkSession, run)
    return progress


class Delivery(StatefulProcessor):
    """One final result for each message: its first success, or its last failure.

    ``attempt(payload, n)`` makes the n-th try and returns None or what went wrong (an exception
    counts as that).  A failed try is made again after ``backoff`` seconds, twice as many after each,
    until ``most`` were made.  One that is cancelled is given up without a result, since who cancels it has written one.

    A key is a bucket of messages, each of which comes once as a job and once as a cancel at most (``deliver`` sees to that).
    Those that wait are one value, with one timer for the first of them that is due; cancelled ones are remembered, since their job may come later.
    """

    def __init__(self, attempt: Callable[[str, int], str | None], most: int = MOST_ATTEMPTS, backoff: int = 60):
        self.attempt, self.most, self.backoff = attempt, most, backoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "messages string, timer long")  # JSON: [run_id, source, payload, attempts, due]
        self.cancelled = handle.getValueState("cancelled", "run_ids string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        jobs, cancels = [], set()
        for row in rows:
            if row["kind"] == "job":
                jobs.append((row["run_id"], row["source"], row["payload"], 0, row["ms"]))
            elif row["kind"] == "cancel":
                cancels.add(row["run_id"])
        if not jobs and not cancels:
            return
        known = self.cancelled.get()
        gone = cancels.union(json.loads(known[0]) if known else ())
        if cancels:
            self.cancelled.update((json.dumps(list(gone)),))
        waiting, timer = self._waiting()
        before, waiting = len(waiting), [x for x in waiting if x[0] not in cancels]
        same = len(waiting) == before
        for job in jobs:
            if job[0] not in gone:
                yield from self._try(*job, job[4], waiting)
        if not same or len(waiting) != before:
            self._wait(waiting, timer)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now, waiting = timerValues.getCurrentWatermarkInMs(), []
        for message in self._waiting()[0]:
            yield from self._try(*message, now, waiting)
        self._wait(waiting, None)

    def _waiting(self) -> tuple[list, int | None]:
        held = self.waiting.get()
        return (json.loads(held[0]), held[1]) if held else ([], None)

    def _try(self, run_id: str, source: str, payload: str, attempts: int, due: int, now: int, waiting: list) -> Iterator[Row]:
        """All tries that are due by ``now``; what isn't done then waits."""
        while due <= now:
            attempts += 1
            try:
                error = self.attempt(payload, attempts)
            except Exception as failure:  # noqa: BLE001  (whatever a scraper raises is a failed try)
                error = str(failure) or type(failure).__name__
            if error is None or attempts >= self.most:
                yield Row(run_id=run_id, source=source, status="success" if error is None else "failed", attempts=attempts, error=error)
                return
            due += 1000 * self.backoff * 2 ** (attempts - 1)
        waiting.append((run_id, source, payload, attempts, due))

    def _wait(self, waiting: list, timer: int | None) -> None:
        first = min((x[4] for x in waiting), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if waiting:
            self.waiting.update((json.dumps(waiting), first))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


RESULT = "run_id string, source string, status string, attempts int, error string"


_MESSAGE = ("run_id", "kind", "source", "payload", "at")


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows of one run_id and kind the first by (at, payload), no payload being an empty one; ticks keep their last."""
    rows = pa.Table.from_batches(got) if (got := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    since = pc.cast(rows["at"], pa.int64())
    order = pa.table({"run_id": rows["run_id"], "kind": rows["kind"], "at": pc.if_else(pc.equal(rows["kind"], TICK), pc.negate(since), since), "payload": pc.fill_null(rows["payload"], ""), "source": rows["source"]})
    rows = rows.take(pc.sort_indices(order, [(c, "ascending") for c in order.column_names])).combine_chunks()
    differs = lambda c: pc.fill_null(pc.not_equal(rows[c][1:], rows[c][:-1]), True)  # noqa: E731  null isn't equal to null: both stay here
    new = pc.or_(differs("run_id"), differs("kind"))
    yield from rows.filter(pa.concat_arrays([pa.array([True]), *new.chunks])).to_batches(max_chunksize=10_000)


def deliver(messages: DataFrame, attempt: Callable[[str, int], str | None], most: int = MOST_ATTEMPTS, backoff: int = 60, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """Results (RESULT) of a stream of messages: run_id, kind (job, cancel or tick), source, payload, at (timestamp).

    Of copies in one micro-batch the first by (at, payload) is taken; what comes again later is passed over by Spark's own keyed state.
    What is left goes to Python in ``buckets`` groups, since each group costs some milliseconds there; a checkpoint holds to their number.
    """
    first = messages.select(*_MESSAGE).repartition("run_id").mapInArrow(_first_copies, messages.select(*_MESSAGE).schema)
    once = first.withWatermark("at", late).dropDuplicates(["run_id", "kind"])
    stream = once.select(F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"), *_MESSAGE[:4], F.unix_millis("at").alias("ms")).groupBy("bucket")
    return stream.transformWithState(Delivery(attempt, most, backoff), RESULT, "append", "eventTime")


def run_delivery(results: DataFrame, folder: str) -> list[dict]:
    """Write a stream of results to two tables, ``folder/done`` and ``folder/failed``, one folder for each micro-batch."""
    progress: list[dict] = []

    def save(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        batch.where("status = 'success'").write.mode("overwrite").parquet(f"{folder}/done/epoch={epoch}")
        batch.where("status = 'failed'").write.mode("overwrite").parquet(f"{folder}/failed/epoch={epoch}")
        batch.unpersist()

    def run() -> None:
        query = results.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        progress.extend(query.recentProgress)

    with_rocksdb(results.sparkSession, run)
    return progress


class Threshold(StatefulProcessor):
    """Reports when a key comes to ``threshold`` events within ``days``; events count in order of time, whatever order they come in.

    An event waits, counted with others of its millisecond, for the watermark to pass it: its
    timer sets the order.  Of those past, at most ``threshold`` times are kept, and none beyond ``days``.
    """

    def __init__(self, threshold: int, days: int):
        self.threshold, self.live = threshold, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "at long", "n int")
        self.recent = handle.getValueState("recent", "times array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        for row in rows:
            if row["kind"] != TICK:
                at = (int(row["at"].timestamp() * 1000),)
                known = self.pending.getValue(at)[0] if self.pending.containsKey(at) else 0
                self.pending.updateValue(at, (min(known + 1, self.threshold),))
                if not known:
                    self.handle.registerTimer(at[0])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        times = [t for t in (self.recent.get()[0] if self.recent.exists() else []) if now - t < self.live]
        if self.pending.containsKey((now,)):
            before = len(times)
            times = (times + [now] * self.pending.getValue((now,))[0])[-self.threshold :]
            self.pending.removeKey((now,))
            self.handle.registerTimer(now + self.live)  # the time to live of this one
            if len(times) >= self.threshold > before:
                yield Row(key=key[0], at=now, n=len(times))
        if times:
            self.recent.update((times,))
        elif self.recent.exists():
            self.recent.clear()

    def close(self) -> None:
        pass


def threshold_reached(events: DataFrame, threshold: int = 3, days: int = 30, late: str = "1 hour") -> DataFrame:
    """(key, at, n) whenever a key of the stream (key, kind, at timestamp) comes to ``threshold`` events within ``days``."""
    found = events.withWatermark("at", late).groupBy("key").transformWithState(Threshold(threshold, days), "key string, at long, n int", "append", "eventTime")
    return found.select("key", F.timestamp_millis("at").alias("at"), "n")


class StageFold(StatefulProcessor):
    """A subject's stage after all its events so far in order of (at, event_id), in whatever order and batches they come.

    Until a stage other than empty or dormant comes, each takes the place of the one before;
    that first one decides, with what stood just before it, and from then on the highest rank counts.  Kept are
    the first such event, the last one, the highest rank, and the idle ones before the first:
    sums of any two parts are those of the whole, and a late event changes what it would have changed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        event = "struct<at:long,id:long,stage:string>"
        self.fold = handle.getValueState("fold", f"first {event}, last {event}, top int")
        self.idle = handle.getMapState("idle", "at long, id long", "stage string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        first, last, top = self.fold.get() if self.fold.exists() else (None, None, -1)
        first, last = (tuple(x) if x is not None else None for x in (first, last))
        for row in rows:
            event = (int(row["at"].timestamp() * 1_000_000), row["event_id"], row["stage"] or "")
            last = event if last is None else max(last, event)
            if event[2] in _IDLE:
                if first is None or event < first:
                    self.idle.updateValue(event[:2], (event[2],))
            else:
                first = event if first is None else min(first, event)
                top = max(top, STAGE_RANK.get(event[2], 0))
        before = None
        for at, stage in list(self.idle.iterator()):
            event = (*at, stage[0])
            if first is not None and event > first:  # nothing can make it count again
                self.idle.removeKey(tuple(at))
            elif before is None or event > before:
                before = event
        self.fold.update((first, last, top))
        yield Row(subject=key[0], stage=self._stage(first, last, top, before))

    @staticmethod
    def _stage(first: tuple | None, last: tuple, top: int, before: tuple | None) -> str:
        if first is None:
            return last[2]
        start = "qualifie" if first[2] == "nouveau" and before is not None and before[2] == "dormant" else first[2]
        if start == "perdu" or top <= STAGE_RANK.get(start, 0):
            return start
        return next(stage for stage, rank in STAGE_RANK.items() if rank == top)

    def close(self) -> None:
        pass


def fold_stages_stream(events: DataFrame) -> DataFrame:
    """(subject, stage) after each micro-batch that has events of a subject, of a stream (subject long, at timestamp, event_id long, stage)."""
    return events.groupBy("subject").transformWithState(StageFold(), "subject long, stage string", "update", "none")


def latest(epochs: DataFrame, key: str, *values: str) -> DataFrame:
    """Each key's values of the last micro-batch that has it, of a table in folders by epoch."""
    return epochs.groupBy(key).agg(F.max_by(F.struct(*values), "epoch").alias("v")).select(key, *[f"v.{x}" for x in values])
