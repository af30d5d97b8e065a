"""Change-log tables: micro-batches append, readers merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def append_batches(stream: DataFrame, folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
                   mode: str = "append") -> StreamingQuery:
    """Write each micro-batch to its own folder ``batch_id=n``, replacing it if the batch is replayed.

    Writing a batch twice leaves one copy, so a restart after a lost driver neither drops nor repeats
    rows; and no batch ever rewrites the table.
    """
    def store(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{folder}/{BATCH}={number}")

    return (
        stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All stored batches, with their number."""
    return spark.read.schema(f"{schema}, {BATCH} BIGINT").parquet(folder)
