"""Settings of an engine, checked when made."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass, field
from typing import Any

METRICS = ("cosine", "dot", "euclidean")
MODES = ("semantic", "keyword", "hybrid", "auto")
FUSIONS = ("weighted", "rrf")


@dataclass
class Config:
    embedding_model: str = "paraphrase-multilingual-MiniLM-L12-v2"
    embedding_dimension: int = 384
    embedding_provider: str = "local"
    vector_store: str = "local"
    storage_path: str = ".lexloom"
    collection: str = "default"
    metric: str = "cosine"
    search_mode: str = "auto"
    top_k: int = 5
    score_threshold: float = 0.0
    chunk_size: int = 500
    chunk_overlap: int = 50
    fusion_method: str = "weighted"
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    reranker: str | None = None
    reranker_model: str = "cross-encoder"
    rerank_candidates: int = 25
    llm_provider: str = "template"
    llm_model: str = "template-extractive"
    rag_confidence_threshold: float = 0.0
    llm_options: dict[str, Any] = field(default_factory=dict)
    lazy: bool = True
    device: str | None = None
    embedding_options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rules = {
            "embedding_dimension, top_k, chunk_size and rerank_candidates are positive": min(self.embedding_dimension, self.top_k, self.chunk_size, self.rerank_candidates) > 0,
            "score_threshold and rag_confidence_threshold lie in [0, 1]": all(0 <= x <= 1 for x in (self.score_threshold, self.rag_confidence_threshold)),
            "chunk_overlap lies in [0, chunk_size)": 0 <= self.chunk_overlap < self.chunk_size,
            "weights are not negative and not both 0": min(self.semantic_weight, self.keyword_weight) >= 0 < self.semantic_weight + self.keyword_weight,
            f"metric is one of {METRICS}": self.metric in METRICS,
            f"search_mode is one of {MODES}": self.search_mode in MODES,
            f"fusion_method is one of {FUSIONS}": self.fusion_method in FUSIONS,
        }
        broken = [rule for rule, holds in rules.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken))
        if self.embedding_provider == "local" and importlib.util.find_spec("sentence_transformers") is None:
            self.embedding_provider, self.embedding_model, self.embedding_dimension = "hashing", "hashing-ngram", 256
