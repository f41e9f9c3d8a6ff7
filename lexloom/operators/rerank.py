"""Reranking: Dice overlap natively, and a hook for cross-encoders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import ConfigurationError, RerankingError
from ..functions.text import tokens


def dice(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of the word sets; 0 if either has none."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def _ranked(df: DataFrame, score: Column, k: int | None, digits: int | None) -> DataFrame:
    score = score if digits is None else F.round(score, digits)
    out = df.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "rank")))
    return out if k is None else out.where(F.col("rank") <= k)


def lexical_rerank(results: DataFrame, alpha: float = 0.5, k: int | None = None, query: str = "query", text: str = "text", digits: int | None = None) -> DataFrame:
    """alpha of the score, if positive, and 1 - alpha of the Dice overlap of query and text; ties keep their order."""
    if not 0 <= alpha <= 1:
        raise RerankingError("alpha lies in [0, 1]")
    return _ranked(results, alpha * F.greatest(F.col("score"), F.lit(0.0)) + (1 - alpha) * dice(F.col(query), F.col(text)), k, digits)


def cross_encoder_rerank(results: DataFrame, model: str, k: int | None = None, query: str = "query", text: str = "text") -> DataFrame:
    @F.pandas_udf("double")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            from sentence_transformers import CrossEncoder
        except ImportError as e:
            raise RerankingError("reranker 'cross-encoder' needs the package sentence-transformers") from e
        encoder = CrossEncoder(model)
        for q, t in batches:
            yield pd.Series(1 / (1 + np.exp(-np.asarray(encoder.predict(list(zip(q, t))), float))))

    return _ranked(results, predict(F.col(query), F.col(text)), k, None)


def rerank(results: DataFrame, how: str | None, k: int | None = None, model: str = "") -> DataFrame:
    if how is None:
        return results
    if how == "lexical":
        return lexical_rerank(results, k=k)
    if how == "cross-encoder":
        return cross_encoder_rerank(results, model, k)
    raise ConfigurationError(f"unknown reranker {how!r}")
