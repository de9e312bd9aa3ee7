"""Hybrid search and its evaluation, each as one batched plan over any number of queries."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MAX_QUERY_CHARS, RetrievalConfig
from ..errors import EngineError
from ..functions.embedding import STAMP, deterministic_embedding, embed_column
from ..operators import fts, fusion, gold, metrics, vector
from ..schemas import SCORES
from ..shared import materialise


def refusal(query: Column) -> Column:
    """Why a trimmed question isn't asked; null if it is."""
    n = F.length(F.coalesce(query, F.lit("")))
    return F.when((n < 1) | (n > MAX_QUERY_CHARS), F.lit(f"a query must have 1 to {MAX_QUERY_CHARS} characters"))


def check_queries(spark: SparkSession, queries: dict | DataFrame) -> DataFrame:
    """query_id, query (trimmed), refusal and, where it is given, embedding of questions: a dict or a table of any number.

    Questions of a dict are refused with an error if none of them can be asked.
    """
    if isinstance(queries, dict):
        kind = "bigint" if all(isinstance(q, int) for q in queries) else "string"
        table = spark.createDataFrame([(k, q.strip()) for k, q in queries.items()], f"query_id {kind}, query string")
    else:
        table = queries.withColumn("query", F.regexp_replace("query", r"(?U)^\s+|\s+$", ""))
    checked = table.withColumn("refusal", refusal(F.col("query")))
    if isinstance(queries, dict) and queries and not any(1 <= len(q.strip()) <= MAX_QUERY_CHARS for q in queries.values()):
        raise EngineError("validation_error", f"query {next(iter(queries))} must have 1 to {MAX_QUERY_CHARS} characters")
    return checked


def search(
    chunks: DataFrame, queries: dict | DataFrame, config: RetrievalConfig = RetrievalConfig(), language: str = "english", embedder: Callable = deterministic_embedding, stamp: dict = STAMP,
    scorer: Callable[[Column, Column], Column] | None = None, posted: DataFrame | None = None, stamps: DataFrame | None = None, timings: dict[str, float] | None = None,
) -> DataFrame:
    """query_id, rank, chunk_id, source_id, content and its hash, and the scores, of each query's k best chunks.

    ``chunks``: current rows with id, source_id, content, embedding, stamp. ``queries``: texts by id, or a table query_id, query and, if they are
    embedded already, embedding; those that :func:`refusal` holds against are left out. ``posted``: postings written
    before; without them the chunks are analysed here. ``stamps``: the different stamps of the corpus, if they are kept.
    ``scorer`` (query, content) -> score is used if the config asks for reranking. ``timings`` takes in how many
    milliseconds each stage took on the driver; plans that run later count where they are run.
    """
    spark = chunks.sparkSession
    if config.rerank and scorer is None:
        raise EngineError("unavailable", "no reranker is set", "rerank")
    took: dict[str, float] = {} if timings is None else timings
    questions = materialise(check_queries(spark, queries).where("refusal IS NULL").drop("refusal"), "questions")
    named = chunks.withColumnRenamed("id", "chunk_id")
    near = spark.createDataFrame([], f"query_id {dict(questions.dtypes)['query_id']}, chunk_id {dict(named.dtypes)['chunk_id']}, score double, rank int")
    with timed(took, "embed"):
        embedded = vector.check_stamp(chunks if stamps is None else stamps, stamp)
        if embedded and "embedding" not in questions.columns:
            questions = materialise(questions.withColumn("embedding", embed_column(F.col("query"), stamp["dimensions"], embedder)), "embedded")
    with timed(took, "vector"):
        if embedded:
            near = vector.similarities(named, questions, config.min_similarity, config.candidate_depth)
    with timed(took, "fts"):
        terms = materialise(fts.query_frame(questions, language), "terms")
        by_text = fts.search(fts.postings(named.select("chunk_id", "content"), language) if posted is None else posted, terms, config.candidate_depth, named)
    fused = fusion.fuse(by_text, near, config)
    texts = named.select("chunk_id", "source_id", "content")
    if config.rerank:
        full = fused.where(F.col("fused_rank") <= config.rerank_depth).join(texts, "chunk_id").join(questions.select("query_id", "query"), "query_id")
        out = fusion.rerank(full, scorer(F.col("query"), F.col("content")), config.rerank_depth)
    else:
        best = fusion.top(fused, config.k, "fused_rank")
        out = best.join(texts, "chunk_id").withColumn("rank", F.col("fused_rank")).withColumns({"rerank_score": F.lit(None).cast("double"), "prerank_position": F.lit(None).cast("int")})
    return fusion.top(out, config.k).select("query_id", "rank", "chunk_id", "source_id", "content", F.sha2("content", 256).alias("content_sha256"), "fts_score", "vector_score", "fused_score", "rerank_score", "prerank_position")


@contextlib.contextmanager
def timed(took: dict[str, float], stage: str):
    began = time.perf_counter()
    yield
    took[stage] = round((time.perf_counter() - began) * 1000, 3)


def grouped_scores(results: DataFrame) -> DataFrame:
    """The results with their scores as one struct, as a service sends them."""
    scores = F.struct(*(F.col(f"{x}_score").alias(x) for x in ("fts", "vector", "fused", "rerank"))).cast(SCORES).alias("scores")
    return results.select(*(c for c in results.columns if not c.endswith("_score")), scores)


def evaluate(items: DataFrame, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig(), **how) -> tuple[DataFrame, DataFrame]:
    """Outcomes and slices of a labelled set: ``items`` has item_id, question, split and expected (source_id, content_sha256)."""
    if items.isEmpty():
        raise EngineError("validation_error", "there are no labelled questions", "eval")
    results = search(chunks, items.select(F.col("item_id").alias("query_id"), F.col("question").alias("query")), config, **how)
    state = items.join(gold.liveness(items, chunks), "item_id").withColumn("expected", F.transform("expected", lambda e: e["content_sha256"]))
    found = metrics.outcomes(state, results.select(F.col("query_id").alias("item_id"), "rank", F.col("content_sha256").alias("hash")))
    return found, metrics.slices(found)


def self_check(store: DataFrame, text: str, embedder: Callable = deterministic_embedding, stamp: dict = STAMP) -> dict:
    """Embed, look for the nearest stored vector of the stamp, and say whether it is the text's own."""
    made = embedder(text, stamp["dimensions"])
    near = vector.read_back(store, made, stamp).first()
    return {"vector_id": near["id"] if near else None, "readback_distance": near["distance"] if near else None, "ok": bool(near) and abs(near["distance"]) < 1e-6}
