"""Incremental ingestion as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.chunking import chunk_pages
from lodestone.sources.tables import ChunkStore, to_table

PAGE_SCHEMA = "doc_name string, page_num int, raw_text string"


def ingest_stream(spark: SparkSession, source: str, store: ChunkStore, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Chunks page files as they arrive in ``source`` (Parquet, PAGE_SCHEMA) and returns the query.

    A document's pages must arrive in one batch. A replayed batch replaces the partitions
    that it wrote before, so every document is in the store once. Stops when the folder is
    drained; start it again to go on from the checkpoint.
    """
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def add(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        known = store.load_manifest() or {"next_chunk_id": 0}
        store.write(to_table(chunk_pages(batch, known["next_chunk_id"])))
        top = store.scan().agg(F.max("chunk_id")).first()[0]
        store.save_manifest(known | {"next_chunk_id": max(known["next_chunk_id"], (top if top is not None else -1) + 1)})

    return reader.parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per tumbling window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
