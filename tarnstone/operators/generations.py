"""Generations: what is written aside, made visible by one pointer, and swept afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flip(sources: DataFrame, ready: DataFrame) -> DataFrame:
    """``sources`` pointing at the generations of ``ready`` (source_id, generation, sections); without sections a source is
    ``empty`` and keeps what it shows."""
    at = ready.select(F.col("source_id").alias("id"), F.col("generation").alias("next"), "sections")
    out = sources.join(at, "id", "left")
    has = F.col("sections") > 0
    return out.withColumn("current_generation", F.when(has, F.col("next")).otherwise(F.col("current_generation"))).withColumn("status", F.when(has, "ingested").when(F.col("sections") == 0, "empty").otherwise(F.col("status"))).drop("next", "sections")


def swept(rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows of older generations than their source shows."""
    at = sources.select(F.col("id").alias("source_id"), "current_generation")
    marked = rows.join(at, "source_id", "left").withColumn("old", F.coalesce(F.col("generation") < F.col("current_generation"), F.lit(False)))
    return marked.where("NOT old").drop("old", "current_generation"), marked.where("old").drop("old", "current_generation")


def to_reingest(sources: DataFrame, plugin: str, version: str) -> DataFrame:
    """Jobs (source_id, target_generation) for all sources that a plugin's version made."""
    made = (F.col("plugin_name") == plugin) & (F.col("plugin_version") == version) & (F.col("current_generation") >= 1)
    return sources.where(made).select(F.col("id").alias("source_id"), (F.col("current_generation") + 1).alias("target_generation"))
