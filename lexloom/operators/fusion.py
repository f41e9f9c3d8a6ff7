"""Fusion of ranked lists, and hybrid search.

Lists are one DataFrame (qid, list, key, seq, score, rank): ``list`` numbers the retrievers from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import RetrievalError

RRF_K = 60


def minmax(score: Column, *partition: str) -> Column:
    """Scores, negative ones as 0, to [0, 1] within a list; all 1 where they are all the same."""
    w = W.partitionBy(*partition)
    s = F.greatest(score, F.lit(0.0))
    low, high = F.min(s).over(w), F.max(s).over(w)
    return F.when(high - low < 1e-12, 1.0).otherwise((s - low) / (high - low))


def fuse(lists: DataFrame, weights: list[float], method: str = "weighted", k: int | None = None, digits: int | None = None) -> DataFrame:
    """(qid, key, seq, score, rank): weighted sums of min-max scores, or of 1 / (60 + rank) over the greatest of the query.

    A key that a list lacks gets nothing from it. Of a key in several lists the row of the first stands for
    it, and equal scores keep the order in which the keys first appear.
    """
    if method not in ("weighted", "rrf"):
        raise RetrievalError(f"unknown fusion method {method!r}")
    if not weights:
        raise RetrievalError("fusion needs a weight for each list")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("list") + 1)
    part = minmax(F.col("score"), "qid", "list") if method == "weighted" else 1 / (RRF_K + F.col("rank"))
    scored = lists.withColumn("part", weight * part)
    out = scored.groupBy("qid", "key").agg(F.sum("part").alias("score"), F.min(F.struct("list", "rank", "seq")).alias("at"))
    if method == "rrf":
        out = out.withColumn("score", F.col("score") / F.max("score").over(W.partitionBy("qid")))
    if digits is not None:
        out = out.withColumn("score", F.round("score", digits))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "at.list", "at.rank")
    out = out.withColumn("rank", F.row_number().over(order)).select("qid", "key", F.col("at.seq").alias("seq"), "score", "rank")
    return out if k is None else out.where(F.col("rank") <= k)


def candidate_count(k: int) -> int:
    return max(3 * k, 10)


def hybrid(semantic: DataFrame, keyword: DataFrame, weights: tuple[float, float] = (0.7, 0.3), method: str = "weighted", k: int | None = None, digits: int | None = None) -> DataFrame:
    """Fuses two results (qid, seq, score, rank), each already cut to ``candidate_count`` rows, keyed by seq."""
    tag = lambda df, n: df.select("qid", F.lit(n).alias("list"), F.col("seq").alias("key"), "seq", "score", "rank")
    return fuse(tag(semantic, 0).unionByName(tag(keyword, 1)), list(weights), method, k, digits)
