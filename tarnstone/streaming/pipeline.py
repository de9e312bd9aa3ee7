"""Structured Streaming forms: the job queue with its retries, deduplicated ingest, windows over event time.

Jobs are a keyed table of states (:mod:`tarnstone.sources.sinks`): a claim or an outcome appends the rows that it changes. What
arrives is inserted by id, so a replayed micro-batch changes nothing. Each poll puts stale claims back, claims the oldest
jobs that are due, has the claim on record before any handler runs, and records what became of them: a failure waits twice as long each
time and is final after as many attempts as the job has. A claim is committed only against the state it was made from, so two
workers never hold one job; an outcome counts only while its claim does, so a worker that was given up changes nothing.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs as J
from ..schemas import TABLES
from ..shared import materialise
from ..sources import sinks

#: Jobs claimed in one poll.
CLAIMS = 100
COLUMNS = [c.split()[0] for c in TABLES["jobs"].split(", ")]
#: A handler takes the claimed jobs of its kind; it raises if all of them failed, or returns (id, error) of those that did.
Handler = Callable[[DataFrame], DataFrame | None]


def now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC)


def enqueue(jobs: DataFrame, path: str, max_attempts: int = J.MAX_ATTEMPTS, as_of: datetime.datetime | None = None) -> dict[str, int]:
    """Insert jobs (id, kind, payload), queued and due at once; those whose id is there already change nothing."""
    at = F.lit(as_of or now()).cast("timestamp")
    none = {c: F.lit(None).cast(k) for c, k in (("claimed_by", "string"), ("claimed_at", "timestamp"), ("last_error", "string"))}
    fresh = jobs.select("id", "kind", "payload").withColumns({"status": F.lit("queued"), "attempts": F.lit(0), "max_attempts": F.lit(max_attempts), "run_at": at, **none, "created_at": at})
    return sinks.insert_ignore(fresh.select(*COLUMNS), path, keyed=True)


def claim(spark: SparkSession, path: str, worker: str, as_of: datetime.datetime | None = None, limit: int = 1) -> DataFrame | None:
    """The oldest ``limit`` jobs that are due, now claimed by ``worker`` and by nobody else; None if there are none.

    Claims that are older than the visibility timeout are put back first.
    """
    at = F.lit(as_of or now()).cast("timestamp")

    def change(table: DataFrame | None) -> DataFrame | None:
        if table is None:
            return None
        stale = J.reclaim_stale(table.where("status = 'claimed'"), at).where("status = 'queued'")
        queue = table.where("status = 'queued'").unionByName(stale)
        due = materialise(J.claimable(queue, at, limit), "due")  # ``limit`` rows
        ids = F.broadcast(due.select("id"))
        return J.claim(due, worker, at).unionByName(stale.join(ids, "id", "left_anti")).select(*COLUMNS)

    changed = sinks.upsert(spark, path, "id", change, TABLES["jobs"])
    if changed is None:
        return None
    mine = changed.where("status = 'claimed'")
    return None if mine.isEmpty() else mine


def settle(spark: SparkSession, path: str, claimed: DataFrame, failed: DataFrame, as_of: datetime.datetime | None = None) -> int:
    """Record what became of ``claimed`` jobs: ``failed`` (id, error) of them did, the others succeeded. How many claims still counted."""
    at = F.lit(as_of or now()).cast("timestamp")
    bad = failed.groupBy("id").agg(F.first("error").alias("error"))
    said = materialise(claimed.select("id", "attempts", "claimed_by").join(bad, "id", "left").withColumn("bad", F.col("error").isNotNull()), "settled")

    def change(table: DataFrame | None) -> DataFrame | None:
        if table is None:
            return None
        held = table.where("status = 'claimed'").join(F.broadcast(said), ["id", "attempts", "claimed_by"])
        return J.complete(held.where("NOT bad")).unionByName(J.fail(held.where("bad"), F.col("error"), at)).select(*COLUMNS)

    changed = sinks.upsert(spark, path, "id", change, TABLES["jobs"])
    return 0 if changed is None else changed.count()


def work(spark: SparkSession, path: str, handlers: dict[str, Handler], worker: str = "worker", as_of: datetime.datetime | None = None, limit: int = CLAIMS) -> int:
    """One poll at an instant; how many jobs were claimed."""
    claimed = claim(spark, path, worker, as_of, limit)
    if claimed is None:
        return 0
    mine = J.route(claimed, tuple(handlers)).withColumnRenamed("last_error", "error")
    failed = mine.where("handler IS NULL").select("id", "error")
    for kind, handle in handlers.items():
        part = mine.where(F.col("handler") == kind).drop("error", "handler")
        if not part.isEmpty():
            try:
                said = handle(part)
                failed = failed if said is None else failed.unionByName(said.select("id", F.coalesce(F.col("error").cast("string"), F.lit("failed")).alias("error")))
            except Exception as e:
                failed = failed.unionByName(part.select("id", F.lit(str(e)[:500]).alias("error")))
    settle(spark, path, claimed, failed, as_of)
    return claimed.count()


def drain(spark: SparkSession, path: str, handlers: dict[str, Handler], worker: str = "worker", clock: Callable[[], datetime.datetime] = now) -> int:
    """Polls as long as there was work; how many jobs were claimed."""
    total = 0
    while n := work(spark, path, handlers, worker, clock()):
        total += n
    return total


def read_jobs(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of job files as a stream: a file belongs to one micro-batch only."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_jobs(jobs: DataFrame, path: str, handlers: dict[str, Handler], checkpoint: str, once: bool = True, clock: Callable[[], datetime.datetime] = now) -> StreamingQuery:
    """Jobs (id, kind, payload) as they arrive: each micro-batch is inserted into the table ``path``, then all that is due is worked off."""

    def batch(rows: DataFrame, _: int) -> None:
        enqueue(rows, path, as_of=clock())
        drain(rows.sparkSession, path, handlers, clock=clock)

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def poll(spark: SparkSession, path: str, handlers: dict[str, Handler], checkpoint: str, every: str = "2 seconds", clock: Callable[[], datetime.datetime] = now) -> StreamingQuery:
    """The loop that serves retries, too: whatever is due is worked off ``every`` so often, until the query is stopped."""
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = beat.writeStream.foreachBatch(lambda rows, _: drain(rows.sparkSession, path, handlers, clock=clock) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def once_per_key(rows: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Replays drop out: by key for ever, or within a watermark where there is an event time."""
    return rows.dropDuplicates([key]) if time is None else rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(rows: DataFrame, time: str, size: str, *by: str, late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates per window of event time, batch or stream; ``late`` bounds how long a window waits."""
    source = rows.withWatermark(time, late) if late else rows
    grouped = source.groupBy(F.window(time, size).alias("w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggregates)


def sessions(rows: DataFrame, time: str, gap: str, *by: str, **aggregates: Column) -> DataFrame:
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *aggregates)
