"""Incremental ingest: a stream of documents into a collection, batch by batch (an addition of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine, numbered


def ingest_stream(engine: Engine, documents: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds the rows (document_id, text, source) of a streaming DataFrame. A batch that is run again adds nothing: its chunks are there by content hash."""

    def add(batch: DataFrame, _: int) -> None:
        rows = numbered(batch, "document_id").select("pos", "text", "source", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page"), F.col("document_id").cast("string").alias("document_id"), F.create_map().cast("map<string,string>").alias("metadata"))
        engine.add_documents(rows.where("text IS NOT NULL"))

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
