"""Typed catalog tables as Parquet, partitioned by library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.schemas import TABLES, columns


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the declared schema, in order and cast; missing ones are NULL, unknown ones an error."""
    declared = columns(table)
    unknown = set(df.columns) - {name for name, _ in declared}
    if unknown:
        raise ValueError(f"{table}: unknown columns {sorted(unknown)}")
    return df.select(*[
        (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in declared
    ])


def write_catalog(df: DataFrame, root: str, table: str, mode: str = "overwrite") -> str:
    """Write one table, in files of even size. Overwriting replaces the libraries of ``df`` and keeps all others.

    The rebalance hint gathers a small library in one file and lets adaptive execution split a large one,
    so neither many tiny files nor one giant task results.
    """
    path = f"{root.rstrip('/')}/{table}"
    conform(df, table).hint("rebalance", F.col("library_id")).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy("library_id").parquet(path)
    return path


def read_catalog(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Read one table with its declared schema; a filter on ``library_id`` prunes folders."""
    stored = spark.read.schema(TABLES[table]).parquet(f"{root.rstrip('/')}/{table}")
    return stored.select(*[name for name, _ in columns(table)])
