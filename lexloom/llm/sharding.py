"""Operator 5: proportional stratified interleaving into shards.

Rows are shuffled within each source by a seeded hash and ranked; sorted by their fractional rank
(rank - 1/2) / size of the source, every stretch of the order has the mixture of the whole, so equal
cuts give shards that match it. Ranks are taken in hash buckets plus counts of the buckets before, so
neither a hot source nor the whole order is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def shards(docs: DataFrame, n_shards: int = 64, seed: str = "7", id_col: str = "doc_id", source_col: str = "source", buckets: int = 1024) -> DataFrame:
    """(doc_id, source, position, shard) of every row; positions run from 1, shards from 0.

    A null source is a source of its own; null ids come first among equal hashes; repeated rows have
    neighbouring positions in any order. Shard sizes differ by one at most. An empty table gives an
    empty one; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = rows.withColumn("b", (F.conv(F.substring("h", 1, 5), 16, 10).cast("long") * buckets / (1 << 20)).cast("int"))
    # Rank within the source: rows of its earlier buckets, then the order within the bucket.
    sizes = rows.groupBy("s", "b").agg(F.count("*").alias("c"))
    own = W.partitionBy("s").orderBy("b")
    sizes = sizes.select("s", "b", (F.sum("c").over(own) - F.col("c")).alias("before"), F.sum("c").over(W.partitionBy("s")).alias("n"))
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("s", "b").orderBy("h", "doc_id"))).join(sizes, ["s", "b"])
    ranked = ranked.select("doc_id", "source", "s", "h", ((F.col("r") + F.col("before") - 0.5) / F.col("n")).alias("f"))
    ranked = ranked.withColumn("fb", F.floor(F.col("f") * buckets).cast("int"))
    # Position in the whole order, in the same way by bucket of the fractional rank.
    totals = ranked.groupBy("fb").agg(F.count("*").alias("c"))
    every = W.orderBy("fb").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("fb", F.coalesce(F.sum("c").over(every), F.lit(0)).alias("before"), F.sum("c").over(W.partitionBy(F.lit(0))).alias("total"))
    placed = ranked.withColumn("r", F.row_number().over(W.partitionBy("fb").orderBy("f", "s", "h", "doc_id"))).join(F.broadcast(totals), "fb")  # one row a bucket: `buckets` at most
    position = (F.col("r") + F.col("before")).cast("long")
    return placed.select("doc_id", "source", position.alias("position"), F.floor((position - 1) * n_shards / F.col("total")).cast("long").alias("shard"))


SQL = """
WITH d AS (SELECT doc_id, source, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, coalesce('=' || source, '') AS s FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY s) AS f FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, s, h, doc_id) AS position, count(*) OVER () AS n FROM r)
SELECT doc_id, source, position, CAST(floor((position - 1) * 64::DOUBLE / n) AS BIGINT) AS shard FROM p
"""
