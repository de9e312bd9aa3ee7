"""Seams to models out of process: batches of a bounded size, order kept, every answer checked."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EMBED_BATCH, RERANK_BATCH
from ..errors import EngineError


def embedded(texts: Sequence[str], call: Callable[[list[str]], list[list[float]]], dimensions: int, most: int = EMBED_BATCH) -> list[list[float]]:
    """One vector per text, asked for ``most`` at a time; refuses a wrong number of vectors or of dimensions."""
    out: list[list[float]] = []
    for i in range(0, len(texts), most):
        part = list(texts[i : i + most])
        made = call(part)
        if len(made) != len(part) or any(len(v) != dimensions for v in made):
            raise EngineError("upstream_error", f"the embedder must give {len(part)} vectors of {dimensions} dimensions", "embedding")
        out += made
    return out


def embed_with(call: Callable[[list[str]], list[list[float]]], dimensions: int, most: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """A column function over texts; null stays null."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        there = texts[texts.notna()]
        made = pd.Series(embedded(there.tolist(), call, dimensions, most), index=there.index, dtype=object)
        return made.reindex(texts.index).where(texts.notna(), None)

    return run


def reranked(query: str, passages: Sequence[tuple[str, str]], call: Callable[[str, list[tuple[str, str]]], dict[str, float]], most: int = RERANK_BATCH) -> dict[str, float]:
    """The score of each (id, text), asked for ``most`` at a time; refuses if one has none."""
    out: dict[str, float] = {}
    for i in range(0, len(passages), most):
        part = list(passages[i : i + most])
        scores = call(query, part)
        if missing := [k for k, _ in part if k not in scores]:
            raise EngineError("upstream_error", f"no score for {missing[:3]}", "rerank")
        out |= {k: float(scores[k]) for k, _ in part}
    return out


def rerank_with(call: Callable[[str, list[tuple[str, str]]], dict[str, float]], most: int = RERANK_BATCH) -> Callable[[Column, Column], Column]:
    """A scorer for :func:`tarnstone.plans.search.search`: passages of one query are scored together."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=queries.index)
        for q, rows in texts.groupby(queries):
            scores = reranked(q, [(str(i), t) for i, t in rows.items()], call, most)
            out.loc[rows.index] = [scores[str(i)] for i in rows.index]
        return out

    return run
