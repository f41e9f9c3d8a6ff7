"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, jaccard, licenses, packing, quality, sharding, substrings, token_counts, topk, url_filters

#: A rank file of the installed public tokenizers; any path that all executors can read will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), TOKENIZER)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each row whose id 50 divides, among all rows."""
    return topk.topk_search(_read(spark, sf_dir, "embeddings"), k=10).withColumn("distance", F.round("distance", 5))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), capacity=2048, open_windows=32)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs = _read(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, _read(spark, sf_dir, "labels"))).where("keep").drop("keep")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_read(spark, sf_dir, "documents"), n_shards=64)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(_read(spark, sf_dir, "documents"), width=50)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.match_rules(_read(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near and exact copies and the number of documents that it is linked to."""
    return jaccard.near_classes(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_counts, op2_topk_search, op3_packing, op4_quality, op5_sharding, op6_substring_dedup, op7_decontamination, op8_url_filters, op9_jaccard_join, op10_license_scan, pipeline]
    return {f.__name__: f for f in own}


TOPK_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS x FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, neighbor_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INT) AS rank, neighbor_id, round(x, 5) AS distance FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": TOPK_SQL, "op5_sharding": sharding.SQL, "op6_substring_dedup": substrings.SQL, "op8_url_filters": url_filters.SQL, "op9_jaccard_join": jaccard.SQL, "op10_license_scan": licenses.SQL}
