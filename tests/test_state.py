"""The queue in keyed streaming state: time moves by timers."""

import time

import pytest
from pyspark.sql import functions as F

from tarnstone.sources import sinks
from tarnstone.streaming import state


@pytest.fixture
def stateful(spark):
    before = {k: spark.conf.get(k, None) for k in state.CONF}
    for k, v in state.CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_retries_visibility_and_ends_by_timers(stateful, tmp_path):
    spark, inbox, log = stateful, f"{tmp_path}/in", f"{tmp_path}/log"
    tries: dict[str, list[int]] = {}

    def note(rows):
        got = rows.collect()
        for r in got:
            tries.setdefault(r.id, []).append(r.attempt)
        return got

    def flaky(rows):
        if any(r.attempt < 3 for r in note(rows)):
            raise RuntimeError("boom")

    def partly(rows):
        note(rows)
        return rows.where("id <> 'good'").select("id", F.lit("no").alias("error"))

    jobs = [("flaky", "flaky"), ("good", "part"), ("bad", "part"), ("odd", "nobody"), ("good", "part")]
    state.send(spark.createDataFrame(jobs, "id string, kind string").withColumn("what", F.lit("enqueue")).coalesce(1), inbox)
    queue = state.Queue(visibility=60, backoff=2, unit=500)  # seconds of half a second
    q = state.serve(spark, inbox, log, {"flaky": flaky, "part": partly}, f"{tmp_path}/cp", queue, "500 milliseconds")
    ended = {}
    for _ in range(90):
        time.sleep(1)
        table = sinks.read(spark, log)
        ended = {} if table is None else {r.id: (r.status, r.attempt, r.error) for r in table.where("status IN ('succeeded', 'failed')").collect()}
        if len(ended) == 4 or q.exception():
            break
    # a message for an attempt that is over, and a repeated job, change nothing
    state.send(spark.createDataFrame([("bad", "succeeded", 1), ("good", "enqueue", None)], "id string, what string, attempt int"), inbox)
    time.sleep(5)
    q.stop()
    assert q.exception() is None
    assert ended == {"flaky": ("succeeded", 3, None), "good": ("succeeded", 1, None), "bad": ("failed", 3, "no"), "odd": ("failed", 3, "unknown job kind: nobody")}
    assert tries == {"flaky": [1, 2, 3], "good": [1], "bad": [1, 2, 3]}
    moves = sinks.read(spark, log)
    waits = [(r.attempt, r.status) for r in moves.where("id = 'flaky'").orderBy("batch", "attempt", F.desc("status")).collect()]
    assert waits == [(1, "claimed"), (1, "queued"), (2, "claimed"), (2, "queued"), (3, "claimed"), (3, "succeeded")]
    assert moves.where("id = 'good'").count() == 2  # finished jobs aren't touched again


def test_claims_without_an_outcome_are_given_up(stateful, tmp_path):
    spark, inbox = stateful, f"{tmp_path}/in"
    state.send(spark.createDataFrame([("lost", "enqueue", "work")], "id string, what string, kind string"), inbox)
    queue = state.Queue(max_attempts=2, visibility=2, backoff=1, keep=4, unit=500)
    out = []
    stream = state.moves(state.read_messages(spark, inbox), queue)
    q = stream.writeStream.foreachBatch(lambda rows, n: out.extend((r.id, r.status, r.attempt, r.error) for r in rows.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    for _ in range(60):
        time.sleep(1)
        if len(out) >= 3 or q.exception():
            break
    time.sleep(4)  # the ended job's state is dropped, so its id may come again
    state.send(spark.createDataFrame([("lost", "enqueue", "work")], "id string, what string, kind string"), inbox)
    for _ in range(30):
        time.sleep(1)
        if len(out) >= 4 or q.exception():
            break
    q.stop()
    assert q.exception() is None
    assert out[:4] == [("lost", "claimed", 1, None), ("lost", "claimed", 2, None), ("lost", "failed", 2, "the claim was given up"), ("lost", "claimed", 1, None)]
