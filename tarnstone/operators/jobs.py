"""The job queue as pure functions of a table and an instant: claiming, failing with backoff, reclaiming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds before the first retry; doubled each time.
BACKOFF_SECONDS = 5
MAX_ATTEMPTS = 3
VISIBILITY_SECONDS = 60


def claimable(jobs: DataFrame, as_of: Column, limit: int = 1) -> DataFrame:
    """The oldest queued jobs whose time has come."""
    return jobs.where((F.col("status") == "queued") & (F.col("run_at") <= as_of)).orderBy("created_at", "id").limit(limit)


def claim(jobs: DataFrame, worker: str, as_of: Column) -> DataFrame:
    return jobs.withColumns({"status": F.lit("claimed"), "attempts": F.col("attempts") + 1, "claimed_by": F.lit(worker), "claimed_at": as_of})


def complete(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.lit("succeeded"))


def backoff_seconds(attempts: Column) -> Column:
    return (F.lit(BACKOFF_SECONDS) * F.pow(F.lit(2), F.greatest(F.lit(0), attempts - 1))).cast("long")


def fail(jobs: DataFrame, error: Column, as_of: Column) -> DataFrame:
    """Back to the queue for later, claim cleared, or failed for good with the last claim kept as evidence."""
    done = F.col("attempts") >= F.col("max_attempts")
    later = as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff_seconds(F.col("attempts")))
    keep = lambda c: F.when(done, F.col(c))
    return jobs.withColumns({"status": F.when(done, "failed").otherwise("queued"), "last_error": error, "run_at": F.when(done, F.col("run_at")).otherwise(later), "claimed_by": keep("claimed_by"), "claimed_at": keep("claimed_at")})


def reclaim_stale(jobs: DataFrame, as_of: Column, seconds: int = VISIBILITY_SECONDS) -> DataFrame:
    """Claims older than the visibility timeout go back to the queue."""
    stale = (F.col("status") == "claimed") & (F.col("claimed_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))
    return jobs.withColumns({"status": F.when(stale, "queued").otherwise(F.col("status")), "claimed_by": F.when(~stale, F.col("claimed_by")), "claimed_at": F.when(~stale, F.col("claimed_at"))})


def route(jobs: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Adds the handler of each job; an unknown kind fails."""
    known = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    return jobs.withColumn("handler", F.when(known, F.col("kind"))).withColumn("last_error", F.when(~known, F.concat(F.lit("unknown job kind: "), F.coalesce("kind", F.lit("none")))))
