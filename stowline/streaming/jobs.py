"""Streaming jobs. Each is its batch operator over micro-batches; the checkpoint plays the cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stowline.operators.capacity import DEFAULT_RESERVE, DEFAULT_SLACK
from stowline.operators.inventory import apply_delta
from stowline.operators.journal import drift_verdict, latest_state
from stowline.operators.observability import redact
from stowline.session import new_folder
from stowline.sources.logs import parse_log_lines
from stowline.streaming.tables import BATCH, append_batches, read_batches

ITEM_KEY = ["library_id", "location_id", "item_key"]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def stream_inventory(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append arriving changes, each micro-batch reduced to the latest change per item."""
    payload = [c for c in changes.columns if c not in ITEM_KEY]

    def latest(batch: DataFrame) -> DataFrame:
        newest = batch.groupBy(*ITEM_KEY).agg(F.max_by(F.struct(*payload), "change_no").alias("r"))
        return newest.select(*ITEM_KEY, *[F.col(f"r.{c}").alias(c) for c in payload])

    return append_batches(changes, folder, checkpoint, latest)


def read_inventory(base: DataFrame, changes: DataFrame, folder: str) -> DataFrame:
    """Current inventory: the base snapshot with the stored changes merged in."""
    log = read_batches(base.sparkSession, folder, _ddl(changes)).drop(BATCH)
    return apply_delta(base, log)


def compact_inventory(base: DataFrame, changes: DataFrame, folder: str, snapshot: str) -> DataFrame:
    """Write the merged inventory as a plain table for other tools; ``snapshots.compact`` shortens the log itself."""
    read_inventory(base, changes, folder).write.mode("overwrite").parquet(snapshot)
    return base.sparkSession.read.schema(base.schema).parquet(snapshot)


def redacted(lines: DataFrame) -> DataFrame:
    """Parsed and masked log lines of a batch or stream."""
    return redact(parse_log_lines(lines))


def stream_redact(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Store arriving log lines masked; nothing unmasked reaches the sink."""
    return (
        redacted(lines).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_metrics(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Running totals of counters and latest gauges; each batch writes the metrics that changed.

    The state is one row per metric name.
    """
    running = events.groupBy("name", "kind").agg(
        F.sum("value").alias("total"), F.max_by("value", F.struct("ts", "value")).alias("last"))
    return append_batches(running, folder, checkpoint, mode="update")


def read_metrics(spark: SparkSession, folder: str, value: str = "BIGINT") -> DataFrame:
    """Newest stored row per metric; ``value`` is the type of the values that were streamed, DOUBLE for fractional gauges."""
    stored = read_batches(spark, folder, f"name STRING, kind STRING, total {value}, last {value}")
    newest = stored.groupBy("name", "kind").agg(F.max_by(F.struct("total", "last"), BATCH).alias("m"))
    return newest.select("name", "kind", F.when(F.col("kind") == "counter", F.col("m.total")).otherwise(F.col("m.last")).alias("value"))


def drift_alerts(readings: DataFrame, next_ops: DataFrame, slack: int = DEFAULT_SLACK, reserve: int = DEFAULT_RESERVE) -> DataFrame:
    """Drift verdict of each arriving reading against the operation that waits on its volume.

    ``next_ops`` holds one row per (library_id, location_id); the join is stream to static table.
    """
    joined = readings.join(next_ops, ["library_id", "location_id"])
    return drift_verdict(joined, slack, reserve).filter(F.col("reason").isNotNull())


def stream_drift(readings: DataFrame, next_ops: DataFrame, folder: str, checkpoint: str, slack: int = DEFAULT_SLACK,
                 reserve: int = DEFAULT_RESERVE) -> StreamingQuery:
    return (
        drift_alerts(readings, next_ops, slack, reserve).writeStream.format("parquet").option("path", folder)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def stream_journal(transitions: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Latest state per op and batch, without state of its own: each batch stores its newest row per op, readers merge.

    ``stream_transitions`` audits the same stream.
    """
    return append_batches(transitions, folder, checkpoint, latest_state)


def read_journal(transitions: DataFrame, folder: str) -> DataFrame:
    """Newest stored state per op."""
    stored = read_batches(transitions.sparkSession, folder, _ddl(transitions))
    return latest_state(stored.drop(BATCH))


def run_to_end(query: StreamingQuery) -> None:
    """Wait for a query that processes what is available; a failure raises."""
    query.awaitTermination()


def scratch(spark: SparkSession, label: str) -> tuple[str, str]:
    """Fresh sink and checkpoint folders below the shared folder."""
    root = new_folder(spark, label)
    return f"{root}/table", f"{root}/checkpoint"
