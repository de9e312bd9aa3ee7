"""Observability reads: the timeline of sources and batches, per-source counts, event trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gold import current


def clamp_page(limit: int | None, offset: int | None, most: int = 200, default: int = 50) -> tuple[int, int]:
    return min(most, max(1, default if limit is None else limit)), max(0, offset or 0)


def timeline(sources: DataFrame, batches: DataFrame) -> DataFrame:
    """Standalone sources and batches as one list: kind, id, filename, status, created_at and what only one side has."""
    alone = sources.where("batch_id IS NULL").select(F.lit("source").alias("kind"), "id", "filename", "status", "created_at", "current_generation", F.lit(None).cast("int").alias("entries"))
    grouped = batches.select(F.lit("batch").alias("kind"), "id", "filename", "status", "created_at", F.lit(None).cast("int").alias("current_generation"), F.size("entry_report").alias("entries"))
    return alone.unionByName(grouped)


def page(rows: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Newest first, ties to the larger id."""
    n, skip = clamp_page(limit, offset)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(skip).limit(n)


def source_counts(sources: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections and chunks of each source's current generation; zero where there are none."""
    counted = [current(t, sources).groupBy("source_id").agg(F.count("*").alias(n)) for t, n in ((sections, "sections"), (chunks, "chunks"))]
    out = sources.select(F.col("id").alias("source_id"))
    for c in counted:
        out = out.join(c, "source_id", "left")
    return out.fillna(0, ["sections", "chunks"])


def kept_counts(sources: DataFrame, counted: DataFrame) -> DataFrame:
    """The same as :func:`source_counts` from the counts that commits keep: ``counted`` has id, generation, sections, chunks."""
    at = counted.select(F.col("id").alias("source_id"), F.col("generation").alias("current_generation"), "sections", "chunks")
    heads = sources.select(F.col("id").alias("source_id"), "current_generation")
    return heads.join(at, ["source_id", "current_generation"], "left").select("source_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sections", "chunks")))


def batch_summary(batches: DataFrame, sources: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """batch_id, total and skipped report entries, and its members by status."""
    members = sources.where("batch_id IS NOT NULL").groupBy("batch_id").pivot("status", list(statuses)).count()
    report = batches.select(F.col("id").alias("batch_id"), F.size("entry_report").alias("total"), F.size(F.filter("entry_report", lambda e: e["status"] == "skipped")).alias("skipped"))
    return report.join(members, "batch_id", "left").fillna(0, list(statuses))


def trail(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The events of each ``key`` in order, as one array."""
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("trail"))  # one subject's events


def scrub_failure(kind: Column, stage: Column, message: Column) -> Column:
    """What a row keeps of a failure: its class, stage and whole message, no trace."""
    return F.struct(kind.alias("class"), stage.alias("stage"), message.alias("message"))
