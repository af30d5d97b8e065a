"""What Spark's readers and writers don't offer on a shared folder: to list sub-folders and to delete one."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def partitions(spark: SparkSession, folder: str, column: str, finished: bool = False) -> dict[str, str]:
    """Value and place of each folder ``column=value`` below ``folder``; with ``finished`` those that a job has completed."""
    path, system = _path(spark, f"{folder}/{column}=*" + ("/_SUCCESS" if finished else ""))
    found = system.globStatus(path) or []
    places = [str((s.getPath().getParent() if finished else s.getPath()).toString()) for s in found]
    return {place.rsplit("=", 1)[1]: place for place in places}


def remove(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path, system = _path(spark, folder)
    return system.exists(path)
