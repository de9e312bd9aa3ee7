"""Labelled questions and what has become of the passages they expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from .numbering import numbered


def current(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The reader predicate: rows of a source's current generation. ``rows``: source_id, generation and more."""
    at = sources.select(F.col("id").alias("source_id"), F.col("current_generation").alias("generation"))
    return rows.join(at, ["source_id", "generation"], "left_semi")


def current_in_place(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The same over tables bucketed by source (:func:`tarnstone.sources.buckets.publish`): sources meet where they are, nothing is exchanged.

    The generation isn't a key of the join, as the buckets aren't dealt by it.
    """
    at = sources.select(F.col("source_id").alias("_source"), F.col("current_generation").alias("_at"))
    return rows.join(at, (F.col("source_id") == F.col("_source")) & (F.col("generation") >= F.col("_at")) & (F.col("generation") <= F.col("_at")), "left_semi")


def superseded_in_place(results: DataFrame, live: DataFrame) -> DataFrame:
    """The flag of :func:`superseded` for ``results`` and ``live`` (source_id, content_sha256) bucketed by source, one row per source and hash."""
    held = live.select(F.col("source_id").alias("_source"), F.col("content_sha256").alias("_hash"), F.lit(True).alias("_live"))
    same = (F.col("source_id") == F.col("_source")) & F.startswith(F.col("content_sha256"), F.col("_hash"))
    return results.join(held, same, "left").withColumn("superseded", F.col("_live").isNull()).drop("_source", "_hash", "_live")


def hashes(current_chunks: DataFrame) -> DataFrame:
    return current_chunks.select("source_id", F.sha2("content", 256).alias("content_sha256")).distinct()


def superseded(results: DataFrame, current_chunks: DataFrame) -> DataFrame:
    """``results`` (source_id, content_sha256 and more) with a flag: no current chunk of the same source has that text."""
    live = hashes(current_chunks).withColumn("live", F.lit(True))
    return results.join(live, ["source_id", "content_sha256"], "left").withColumn("superseded", F.col("live").isNull()).drop("live")


def needs_reconfirmation(items: DataFrame, current_chunks: DataFrame) -> DataFrame:
    """item_id and a flag: an expected passage is no current chunk of its source any more. Items that expect nothing don't."""
    expected = items.select("item_id", F.explode("expected").alias("e")).select("item_id", "e.source_id", "e.content_sha256")
    lost = superseded(expected, current_chunks).groupBy("item_id").agg(F.bool_or("superseded").alias("needs_reconfirmation"))
    return items.select("item_id").join(lost, "item_id", "left").fillna({"needs_reconfirmation": False})


def liveness(items: DataFrame, current_chunks: DataFrame) -> DataFrame:
    """item_id and unresolvable: some expected text exists in no source's current generation."""
    live = current_chunks.select(F.sha2("content", 256).alias("content_sha256")).distinct().withColumn("live", F.lit(True))
    expected = items.select("item_id", F.explode("expected").alias("e")).select("item_id", "e.content_sha256")
    gone = expected.join(live, "content_sha256", "left").groupBy("item_id").agg(F.bool_or(F.col("live").isNull()).alias("unresolvable"))
    return items.select("item_id").join(gone, "item_id", "left").fillna({"unresolvable": False})


def default_split(items: DataFrame, created: str, item: str, *corpus: str) -> DataFrame:
    """``items`` with ``split``: every fourth question of a corpus, in order of creation, is held out. A corpus of any size takes as many tasks as it needs."""
    nth = numbered(items, "nth", list(corpus), F.col(created), F.col(item))
    return nth.withColumn("split", F.when(F.col("nth") % 4 == 0, "heldout").otherwise("tuning")).drop("nth")


def unresolved(questions: DataFrame, current_chunks: DataFrame) -> DataFrame:
    """item_id, nth and chunk_id of what ``questions`` (item_id, chunk_ids) name that is no current chunk: each such question is refused."""
    ids = questions.select("item_id", F.posexplode("chunk_ids").alias("nth", "chunk_id"))
    return ids.join(current_chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select("item_id", "nth", "chunk_id")


def resolve_expected(questions: DataFrame, current_chunks: DataFrame) -> DataFrame:
    """``questions`` (item_id, chunk_ids and more) with ``expected``; refuses ids that are not current."""
    missing = [r["chunk_id"] for r in unresolved(questions, current_chunks).limit(5).collect()]
    if missing:
        raise EngineError("validation_error", f"not among the current chunks: {missing}", "gold")
    ids = questions.select("item_id", F.posexplode("chunk_ids").alias("nth", "chunk_id"))
    found = ids.join(current_chunks.select(F.col("id").alias("chunk_id"), "source_id", F.sha2("content", 256).alias("content_sha256")), "chunk_id")
    entry = F.struct("nth", F.struct("chunk_id", "source_id", "content_sha256").alias("e"))
    listed = found.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("expected"))
    return questions.join(listed, "item_id").drop("chunk_ids")


def relabel(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest wins; the split of a question never changes."""
    fields = [c for c in changes.columns if c not in ("item_id", "split")]
    renamed = changes.select("item_id", *(F.col(c).alias(f"new_{c}") for c in fields))
    return items.join(renamed, "item_id", "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in items.columns))
