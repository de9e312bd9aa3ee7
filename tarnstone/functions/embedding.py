"""The offline embedder: a unit vector that depends on nothing but the text's SHA-256."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stamp of the vectors made here.
STAMP = {"provider": "fixture", "model": "deterministic-v1", "dimensions": 32}


def deterministic_embedding(text: str, dimensions: int = 32) -> list[float]:
    """Xorshift draws seeded by the digest's first four bytes, each shifted by a further byte of it, at length one."""
    digest = hashlib.sha256(text.encode()).digest()
    state = int.from_bytes(digest[:4], "big") or 0x9E3779B9
    drawn = []
    for i in range(dimensions):
        state = (state ^ state << 13) & 0xFFFFFFFF
        state ^= state >> 17
        state = (state ^ state << 5) & 0xFFFFFFFF
        drawn.append((state + digest[i % len(digest)]) % 2000 / 1000 - 1)
    length = sum(x * x for x in drawn) ** 0.5 or 1.0
    return [x / length for x in drawn]


def embed_column(text: Column, dimensions: int = 32, embedder=deterministic_embedding) -> Column:
    """Embeds in Arrow batches; ``embedder`` is any picklable (text, dimensions) -> list of floats."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}
        return texts.map(lambda t: None if t is None else known.setdefault(t, None) or known.__setitem__(t, embedder(t, dimensions)) or known[t])

    return run(text)
