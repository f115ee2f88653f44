"""New deliveries of papers as a stream: each micro-batch is added to a table once, however often it is retried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quirework.operators.deltas import Store


def adding(store: Store, name: str, transform: Callable[[DataFrame], DataFrame] | None = None, stream: str = "stream", compact_every: int = 0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch's rows to a table of the store.

    The batch's number is part of the same commit as its rows, so a batch that
    comes again after a failure changes nothing. Only the batch is written; every
    ``compact_every`` batches, if positive, the table is compacted.
    """

    def run(batch: DataFrame, number: int) -> None:
        store.commit(f"{stream}-{number}", {name: transform(batch) if transform else batch})
        if compact_every and number % compact_every == compact_every - 1:
            store.compact(name, f"{stream}-{number}-compacted")

    return run


def ingest(spark: SparkSession, source: str, schema: StructType, name: str, target: str, checkpoint: str, files_per_batch: int = 16, compact_every: int = 0) -> StreamingQuery:
    """Starts the stream of new Parquet files in ``source`` into the table ``name`` of the store at ``target``; it stops when all files are in.

    The table is read by ``Store.read``, which lets the last row of a key win.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(adding(Store(spark, target), name, compact_every=compact_every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
