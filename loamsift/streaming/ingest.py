"""Streaming ingestion: each micro-batch of documents is chunked, embedded, deduplicated against the store and added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import Embedder
from ..operators.chunking import ChunkingConfig
from ..operators.index import ChunkStore
from ..plans.api import index_documents, ingest


def ingest_batch(docs: DataFrame, store: ChunkStore, config: ChunkingConfig, embedder: Embedder, threshold: float = 0.95) -> int:
    """Adds what is new in a batch of documents; the number of chunks added. Running it again adds nothing."""
    new = index_documents(docs, config, embedder).select(*store.schema.names)
    rows, _ = ingest(new, store.read(), embedder.dims, threshold)
    return store.add(rows)


def stream_documents(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Documents as they arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def ingest_stream(docs: DataFrame, store: ChunkStore, config: ChunkingConfig, embedder: Embedder, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs ``ingest_batch`` on each micro-batch. A batch that is repeated after a failure changes nothing, as chunk ids are derived from the documents."""

    def each(batch: DataFrame, _: int) -> None:
        ingest_batch(batch, store, config, embedder)

    w = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_arrivals(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, by, n): arrivals by tumbling window; rows later than the watermark are dropped in a stream."""
    t = events.withColumn(at, F.col(at).cast("timestamp"))
    return t.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), by).agg(F.count("*").alias("n"))
