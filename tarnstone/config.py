"""Retrieval, chunking and model-role settings: from the environment, then overrides, validated once."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping

#: Field, variable, default; fixed values.
KNOBS = {
    "fusion": ("RETRIEVAL_FUSION", "rrf"),
    "rrf_k": ("RETRIEVAL_RRF_K", 60),
    "weight_alpha": ("RETRIEVAL_WEIGHT_ALPHA", 0.5),
    "min_similarity": ("RETRIEVAL_MIN_SIMILARITY", 0.2),
    "candidate_depth": ("RETRIEVAL_CANDIDATE_DEPTH", 50),
    "k": ("RETRIEVAL_K", 10),
    "rerank": ("RETRIEVAL_RERANK", False),
    "rerank_depth": ("RETRIEVAL_RERANK_DEPTH", 50),
}
#: Chunk sizes in characters, fixed values.
CHUNKING = {"target_chars": ("CHUNK_TARGET_CHARS", 4000), "overlap_chars": ("CHUNK_OVERLAP_CHARS", 400), "max_chars": ("CHUNK_MAX_CHARS", 6000)}
MAX_UPLOAD_BYTES = 26_214_400
MAX_BATCH_ENTRIES = 200
EMBED_BATCH = 64
RERANK_BATCH = 256
MAX_QUERY_CHARS = 1024


@dataclasses.dataclass(frozen=True)
class RetrievalConfig:
    name: str = "env-default"
    fusion: str = "rrf"
    rrf_k: int = 60
    weight_alpha: float = 0.5
    min_similarity: float = 0.2
    candidate_depth: int = 50
    k: int = 10
    rerank: bool = False
    rerank_depth: int = 50

    def __post_init__(self):
        checks = {
            "fusion": self.fusion in ("rrf", "weighted"),
            "rrf_k": self.rrf_k >= 1,
            "weight_alpha": 0 <= self.weight_alpha <= 1,
            "min_similarity": -1 <= self.min_similarity <= 1,
            "candidate_depth": 1 <= self.candidate_depth <= 500,
            "k": 1 <= self.k <= self.candidate_depth,
            "rerank_depth": 1 <= self.rerank_depth <= RERANK_BATCH,
        }
        for field, fine in checks.items():
            if not fine:
                raise ValueError(f"{KNOBS[field][0]} is out of bounds: {getattr(self, field)}")

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)


@dataclasses.dataclass(frozen=True)
class ChunkingParams:
    target_chars: int = 4000
    overlap_chars: int = 400
    max_chars: int = 6000


def _parse(variable: str, raw: str, default):
    if isinstance(default, bool):
        if raw not in ("on", "off"):
            raise ValueError(f"{variable} must be on or off, got: {raw}")
        return raw == "on"
    try:
        return type(default)(raw)
    except ValueError:
        raise ValueError(f"{variable} must be a number, got: {raw}") from None


def resolve_retrieval(env: Mapping[str, str], **overrides) -> RetrievalConfig:
    """Overrides win over the environment; reranking needs the reranker role."""
    if unknown := set(overrides) - {"name", *KNOBS}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    values = {f: _parse(v, env[v], d) if v in env else d for f, (v, d) in KNOBS.items()}
    config = RetrievalConfig(**(values | {k: v for k, v in overrides.items() if v is not None}))
    if config.rerank and not env.get("RERANKER_PROVIDER"):
        raise ValueError("RETRIEVAL_RERANK=on needs the reranker role: set RERANKER_PROVIDER and RERANKER_MODEL_ID")
    return config


def resolve_chunking(env: Mapping[str, str]) -> ChunkingParams:
    values = {f: _parse(v, env[v], d) if env.get(v) else d for f, (v, d) in CHUNKING.items()}
    for f, x in values.items():
        if x <= 0:
            raise ValueError(f"{CHUNKING[f][0]} must be a positive integer, got: {x}")
    return ChunkingParams(**values)


def resolve_role(env: Mapping[str, str], role: str, required: bool = False) -> dict | None:
    """Provider, model and dimensions of a model role; an empty provider disables it."""
    role = role.upper()
    provider, model, dims = (env.get(f"{role}_{x}", "") for x in ("PROVIDER", "MODEL_ID", "DIMENSIONS"))
    if not provider:
        if required:
            raise ValueError(f"{role}_PROVIDER is not set")
        return None
    if not model:
        raise ValueError(f"{role}_MODEL_ID is not set")
    if dims and not (dims.isdigit() and int(dims) > 0):
        raise ValueError(f"{role}_DIMENSIONS must be a positive integer, got: {dims}")
    return {"provider": provider, "model": model, "dimensions": int(dims) if dims else None}
