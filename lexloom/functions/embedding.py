"""Feature-hashed character n-gram embeddings, and hooks for model-based ones."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ..config import Config
from ..errors import ConfigurationError, ModelLoadError

NGRAMS = (2, 3, 4)


def _grams(token: str) -> Iterator[str]:
    for n in NGRAMS:
        yield from (token[i : i + n] for i in range(max(1, len(token) - n + 1)))


def hash_vectors(texts: list[str], dim: int, cache: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Row per text: signed counts of hashed n-grams of its words, of unit length unless it has none."""
    cache = {} if cache is None else cache
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts):
        found = []
        for token in re.findall(r"\w+", text.lower()):
            if token not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                cache[token] = np.array([zlib.crc32(g.encode()) for g in _grams(token)], np.int64)
            found.append(cache[token])
        if found:
            h = np.concatenate(found)
            row += np.bincount(h % dim, np.where(h & 1, 1.0, -1.0), dim).astype(np.float32)
            norm = np.linalg.norm(row)
            if norm > 0:
                row /= norm
    return out


def hash_embedding(text: Column, dim: int = 256) -> Column:
    if dim <= 0:
        raise ConfigurationError("the dimension of an embedding is positive")

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, np.ndarray] = {}
        for texts in batches:
            yield pd.Series(list(hash_vectors(texts.fillna("").tolist(), dim, cache)), index=texts.index)

    return embed(text)


def model_embedding(text: Column, model: str, options: dict) -> Column:
    """By a sentence-transformers model, loaded once in a worker."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise ModelLoadError("embedding_provider 'local' needs the package sentence-transformers") from e
        encoder = SentenceTransformer(model, **options)
        for texts in batches:
            yield pd.Series(list(encoder.encode(texts.fillna("").tolist(), batch_size=32).astype(np.float32)), index=texts.index)

    return embed(text)


def embedder(config: Config) -> Callable[[Column], Column]:
    if config.embedding_provider == "hashing":
        return lambda text: hash_embedding(text, config.embedding_dimension)
    if config.embedding_provider == "local":
        return lambda text: model_embedding(text, config.embedding_model, config.embedding_options)
    raise ConfigurationError(f"unknown embedding provider {config.embedding_provider!r}")
