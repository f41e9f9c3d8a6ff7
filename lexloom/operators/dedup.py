"""Deduplication by content hash, in the order of ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_of_each(rows: DataFrame, key: str = "content_hash", seq: str = "seq") -> DataFrame:
    """The first row of each key, one of those of equal ``seq``, and every row of an empty or null key. One aggregation, which combines before it shuffles, reads the rows once."""
    alone = F.when(F.coalesce(F.col(key), F.lit("")) == "", F.monotonically_increasing_id())
    named = rows.select(F.struct("*").alias("_row"), F.when(alone.isNull(), F.col(key)).alias("_key"), alone.alias("_alone"), F.col(seq).alias("_seq"))
    return named.groupBy("_key", "_alone").agg(F.min_by("_row", F.struct(F.col("_seq").isNull(), "_seq")).alias("_row")).select("_row.*")


def not_in(rows: DataFrame, store: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows whose key the store lacks."""
    return rows.join(store.select(key).where(F.col(key) != "").distinct(), key, "left_anti")
