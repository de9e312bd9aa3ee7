"""Fusion of two best-first candidate lists per query, and reranking; any number of queries at once.

Candidates are rows (query_id, chunk_id, score, rank). One shuffle by (query_id, chunk_id) merges the lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RetrievalConfig


def ranked(candidates: DataFrame, depth: int | None = None) -> DataFrame:
    """Adds the 1-based rank of each query's candidates, ties to the smaller chunk_id; keeps ``depth`` of them."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    out = candidates.withColumn("rank", F.row_number().over(w))
    return out if depth is None else out.where(F.col("rank") <= depth)


def _normalized(c: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return c.withColumn("norm", F.when(low == high, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(fts: DataFrame, vector: DataFrame, config: RetrievalConfig) -> DataFrame:
    """query_id, chunk_id, fts_score, vector_score, fused_score and fused_rank of the union of both lists."""
    sides = []
    for name, c in (("fts", fts), ("vector", vector)):
        if config.fusion == "rrf":
            part = 1.0 / (config.rrf_k + F.col("rank"))
        else:
            c = _normalized(c)
            part = F.col("norm") * (config.weight_alpha if name == "vector" else 1 - config.weight_alpha)
        sides.append(c.select("query_id", "chunk_id", *(F.when(F.lit(n == name), F.col("score")).alias(f"{n}_score") for n in ("fts", "vector")), part.alias("part")))
    merged = sides[0].unionByName(sides[1]).groupBy("query_id", "chunk_id").agg(F.max("fts_score").alias("fts_score"), F.max("vector_score").alias("vector_score"), F.sum("part").alias("fused_score"))
    w = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), F.col("chunk_id").asc())
    return merged.withColumn("fused_rank", F.row_number().over(w))


def rerank(fused: DataFrame, score: Column, depth: int) -> DataFrame:
    """The ``depth`` best fused rows reordered by ``score``, ties by fused rank; the old place is prerank_position."""
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("fused_rank").asc())
    return fused.where(F.col("fused_rank") <= depth).withColumn("rerank_score", score).withColumn("rank", F.row_number().over(w)).withColumn("prerank_position", F.col("fused_rank"))


def top(results: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    return results.where(F.col(rank) <= k)
