"""JSON-line logs and metric text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_FIELDS = ("ts", "level", "target", "msg")


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fixed fields plus a map of the free ones; ``message`` is read as ``msg``. Bad lines keep their text.

    Works on batch and streaming frames alike.
    """
    fields = F.from_json(column, "MAP<STRING,STRING>")
    parsed = lines.withColumn("_m", fields).withColumn("_bad", F.col("_m").isNull() | (F.size("_m") == 0))
    free = F.map_filter("_m", lambda k, _: ~k.isin(*LOG_FIELDS, "message"))
    return parsed.select(
        F.try_to_timestamp(F.element_at("_m", "ts")).alias("ts"),
        F.element_at("_m", "level").alias("level"),
        F.element_at("_m", "target").alias("target"),
        F.coalesce(F.element_at("_m", "msg"), F.element_at("_m", "message")).alias("msg"),
        F.when(~F.col("_bad"), free).alias("fields"),
        F.when(F.col("_bad"), F.col(column)).alias("corrupt_line"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def write_prometheus(text: DataFrame, path: str) -> None:
    """Write exposition lines as one ordered text file; the row count is the number of metric names."""
    text.orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(path)
