"""The job queue as keyed streaming state: a job's row lives in the state store, and time moves it by timers.

A stream of messages (enqueue, succeeded, failed) meets one state per job id. A new job is handed out at once; a handed-out job
has a timer for its visibility, a failed one for its backoff, and when a timer goes off the job is handed out again, or fails for
good once its attempts are used up. What is handed out and what has ended are the stream's output, so a poll touches the jobs that move and
no others: finished jobs are neither read nor written again. A message for an attempt that is over, and a replayed one, change nothing.

Spark keeps the states in RocksDB, checkpoints them with the stream's progress, and deals keys to tasks by hash; a state whose job has ended is
kept for ``keep`` seconds, in which repeated enqueues of its id are told, and then dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import jobs as J
from ..sources import sinks

#: Messages: what is ``enqueue`` (with kind and payload), ``succeeded`` or ``failed`` (with the attempt that ended and its error).
MESSAGE = "id string, what string, kind string, payload string, attempt int, error string"
#: Output: status is ``claimed`` (handed out as this attempt), ``succeeded``, ``failed`` or ``queued`` (waits for ``due``).
MOVE = "id string, kind string, payload string, status string, attempt int, error string, due timestamp"
STATE = "kind string, payload string, status string, attempts int, timer long, error string"
#: What Spark needs to keep such state.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Queue(StatefulProcessor):
    """One job's life; ``unit`` is how many milliseconds a second has, shorter in tests."""

    def __init__(self, max_attempts: int = J.MAX_ATTEMPTS, visibility: int = J.VISIBILITY_SECONDS, backoff: int = J.BACKOFF_SECONDS, keep: int = 86_400, unit: int = 1000):
        self.max_attempts, self.visibility, self.backoff, self.keep, self.unit = max_attempts, visibility, backoff, keep, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _save(self, job: dict, now: int, seconds: int) -> None:
        """Keep the job with one timer, so many seconds from now."""
        if job["timer"]:
            self.handle.deleteTimer(job["timer"])
        job["timer"] = now + seconds * self.unit
        self.handle.registerTimer(job["timer"])
        self.job.update(tuple(job[c.split()[0]] for c in STATE.split(", ")))

    def _load(self) -> dict | None:
        if not self.job.exists():
            return None
        return dict(zip((c.split()[0] for c in STATE.split(", ")), self.job.get(), strict=True))

    def _hand_out(self, job: dict, now: int) -> dict:
        job |= {"status": "claimed", "attempts": job["attempts"] + 1}
        self._save(job, now, self.visibility)
        return self._move(job)

    def _failed(self, job: dict, error: str, now: int) -> dict:
        """An attempt is over without success: wait twice as long as the last time, or for ever."""
        job["error"] = error
        if job["attempts"] >= self.max_attempts:
            job["status"] = "failed"
            self._save(job, now, self.keep)
        else:
            job["status"] = "queued"
            self._save(job, now, self.backoff * 2 ** max(0, job["attempts"] - 1))
        return self._move(job)

    def _move(self, job: dict) -> dict:
        return {"kind": job["kind"], "payload": job["payload"], "status": job["status"], "attempt": job["attempts"], "error": job["error"], "due": pd.Timestamp(job["timer"], unit="ms")}

    def _frame(self, key, moves: list[dict]) -> Iterator[pd.DataFrame]:
        if moves:
            yield pd.DataFrame([{"id": key[0], **m} for m in moves], columns=[c.split()[0] for c in MOVE.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, moves, job = timerValues.getCurrentProcessingTimeInMs(), [], self._load()
        for batch in rows:
            for m in batch.to_dict("records"):
                if m["what"] == "enqueue":
                    if job is None:
                        job = {"kind": m["kind"], "payload": m["payload"], "status": "queued", "attempts": 0, "timer": 0, "error": None}
                        moves.append(self._hand_out(job, now))
                elif job is not None and job["status"] == "claimed" and job["attempts"] == m["attempt"]:
                    if m["what"] == "succeeded":
                        job |= {"status": "succeeded", "error": None}
                        self._save(job, now, self.keep)
                        moves.append(self._move(job))
                    else:
                        moves.append(self._failed(job, m["error"], now))
        yield from self._frame(key, moves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, job = timerValues.getCurrentProcessingTimeInMs(), self._load()
        if job is None or job["timer"] != expiredTimerInfo.getExpiryTimeInMs():
            return
        job["timer"] = 0  # it has gone off
        if job["status"] in ("succeeded", "failed"):
            self.job.clear()
        elif job["status"] == "claimed" and job["attempts"] >= self.max_attempts:
            yield from self._frame(key, [self._failed(job, "the claim was given up", now)])
        else:
            yield from self._frame(key, [self._hand_out(job, now)])

    def close(self) -> None:
        pass


def moves(messages: DataFrame, queue: Queue | None = None) -> DataFrame:
    """The stream of what happens to jobs, from the stream of ``messages``."""
    return messages.groupBy("id").transformWithStateInPandas(statefulProcessor=queue or Queue(), outputStructType=MOVE, outputMode="Update", timeMode="ProcessingTime")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(MESSAGE).parquet(path)


def send(rows: DataFrame, path: str) -> None:
    """Put messages into the folder that the stream reads; missing columns are null."""
    names = [c.split() for c in MESSAGE.split(", ")]
    rows.select(*(F.col(n).cast(k).alias(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in names)).write.mode("append").parquet(path)


def serve(spark: SparkSession, inbox: str, log: str, handlers: dict[str, Callable[[DataFrame], DataFrame | None]], checkpoint: str, queue: Queue | None = None, every: str = "1 second") -> StreamingQuery:
    """Run the queue over the folder ``inbox``: what is handed out goes to the handler of its kind, whose outcomes come back through the inbox.

    Every move is appended to the table ``log``, once for each micro-batch. A batch that is replayed runs its handlers again, as a claim
    that was lost does; their outcomes count once, by attempt.
    """

    def batch(rows: DataFrame, number: int) -> None:
        at = rows.sparkSession
        path = f"{checkpoint}/moves"
        rows.write.mode("overwrite").parquet(path)
        moved = at.read.schema(MOVE).parquet(path)
        sinks.append(moved.withColumn("batch", F.lit(number)), log, once=(checkpoint, number))
        out = J.route(moved.where("status = 'claimed'").withColumnRenamed("error", "last_error").drop("status"), tuple(handlers)).withColumnRenamed("last_error", "error")
        failed = out.where("handler IS NULL").select("id", "attempt", "error")
        done = []
        for kind, handle in handlers.items():
            part = out.where(F.col("handler") == kind).drop("handler", "error")
            if part.isEmpty():
                continue
            try:
                said = handle(part)
                bad = part.select("id", "attempt").limit(0).withColumn("error", F.lit("")) if said is None else part.select("id", "attempt").join(said.select("id", "error"), "id")
            except Exception as e:
                bad = part.select("id", "attempt", F.lit(str(e)[:500]).alias("error"))
            failed = failed.unionByName(bad)
            done.append(part.select("id", "attempt").join(bad.select("id"), "id", "left_anti"))
        messages = failed.withColumn("what", F.lit("failed"))
        for d in done:
            messages = messages.unionByName(d.withColumns({"what": F.lit("succeeded"), "error": F.lit(None).cast("string")}))
        if not messages.isEmpty():
            send(messages.coalesce(1), inbox)

    return moves(read_messages(spark, inbox), queue).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
