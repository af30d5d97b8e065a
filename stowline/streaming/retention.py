"""A log sink by day, from which expired days are dropped as folders; no kept row is ever written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stowline.operators.observability import DAYS_KEPT
from stowline.streaming import storage
from stowline.streaming.tables import BATCH

DAY = "log_day"
UNDATED = "undated"


def store_days(logs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append arriving log rows (with a time ``ts``) to ``log_day=.../batch_id=...``.

    A batch that is replayed replaces its own folders only. Rows without a time go to the day ``undated``, which never expires.
    """
    def write(batch: DataFrame, number: int) -> None:
        day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(UNDATED))
        batch.withColumn(DAY, day).withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(DAY, BATCH).parquet(folder)

    return (
        logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_days(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All stored rows with their day; a filter on the day reads only its folders."""
    return spark.read.schema(f"{schema}, {DAY} STRING, {BATCH} BIGINT").parquet(folder).drop(BATCH)


def expire_days(spark: SparkSession, folder: str, days: int = DAYS_KEPT) -> list[str]:
    """Delete all but the newest ``days`` log days, by their folders; gives the days that went.

    The days are listed, the log is not read: the cost is one listing and one deletion for each expired day.
    """
    if days < 1:
        raise ValueError("at least one day must be kept")
    found = storage.partitions(spark, folder, DAY)
    dated = sorted(day for day in found if day not in (UNDATED, "__HIVE_DEFAULT_PARTITION__"))
    for day in dated[:-days]:
        storage.remove(spark, found[day])
    return dated[:-days]
