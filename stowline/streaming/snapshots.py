"""Versioned snapshots of a change log, switched by one small write.

A change log grows by one folder per micro-batch. ``compact`` folds the finished batches into a snapshot of its own folder,
which holds the newest row per item with its change number, removed items included, so that a change that arrives later
with a lower number still loses. A manifest row (version, snapshot, highest batch folded) then makes the snapshot the
current one; before that row nothing has changed for a reader, after it the folded batches are ignored, also when the stream
replays one of them. ``vacuum`` deletes what the version before the current one needed no more.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.operators.inventory import apply_delta
from stowline.streaming import storage
from stowline.streaming.tables import BATCH, read_batches

ITEM_KEY = ("library_id", "location_id", "item_key")
MANIFEST = "version BIGINT, snapshot STRING, high_water BIGINT"


@dataclass(frozen=True)
class Version:
    """A manifest row; version 0 stands for a log that was never compacted."""

    version: int = 0
    snapshot: str | None = None
    high_water: int = -1


def _manifest_folder(folder: str) -> str:
    return f"{folder.rstrip('/')}-manifest"


def versions(spark: SparkSession, folder: str) -> list[Version]:
    """The versions of a change log, newest first; one small row per compaction. Of two with one number the one that folded
    more counts, then the greater snapshot name, so two compactions at once do no harm."""
    place = _manifest_folder(folder)
    if not storage.exists(spark, place):
        return [Version()]
    rows = spark.read.schema(MANIFEST).json(place).groupBy("version").agg(F.max(F.struct("high_water", "snapshot")).alias("m"))
    found = [Version(r.version, r.m.snapshot, r.m.high_water) for r in rows.orderBy(F.desc("version")).collect()]
    return [*found, Version()]


def newest_rows(changes: DataFrame) -> DataFrame:
    """The newest change per item, removals included; ties as in ``apply_delta``."""
    payload = [c for c in changes.columns if c not in ITEM_KEY]
    order = F.struct("change_no", "is_deleted", *[c for c in payload if c not in ("change_no", "is_deleted")])
    return changes.groupBy(*ITEM_KEY).agg(F.max_by(F.struct(*payload), order).alias("r")).select(
        *ITEM_KEY, *[F.col(f"r.{c}").alias(c) for c in payload])


def _log(spark: SparkSession, folder: str, schema: str, at: Version, upto: int | None = None) -> DataFrame:
    """The snapshot of a version and the batches after it, as change rows."""
    batches = read_batches(spark, folder, schema).filter(F.col(BATCH) > at.high_water)
    if upto is not None:
        batches = batches.filter(F.col(BATCH) <= upto)
    rows = batches.drop(BATCH)
    return rows if at.snapshot is None else spark.read.schema(rows.schema).parquet(at.snapshot).unionByName(rows)


def compact(spark: SparkSession, folder: str, schema: str) -> Version:
    """Fold the finished batches into a new snapshot and make it the current one; without new batches nothing is done.

    ``schema`` is that of the change rows. A batch that is being written, or written again after a crash, is not finished and
    stays in the log. A crash before the manifest row leaves a snapshot that nothing names, and after it batches that nothing
    reads; :func:`vacuum` takes both away.
    """
    now = versions(spark, folder)[0]
    done = [int(n) for n in storage.partitions(spark, folder, BATCH, finished=True)]
    high = max(done, default=-1)
    if high <= now.high_water:
        return now
    made = Version(now.version + 1, f"{folder.rstrip('/')}-snapshots/v={now.version + 1}-{uuid.uuid4().hex[:8]}", high)
    newest_rows(_log(spark, folder, schema, now, high)).write.parquet(made.snapshot)
    publish(spark, folder, made)
    return made


def publish(spark: SparkSession, folder: str, made: Version) -> None:
    """The switch: one row in one file, which appears whole or not at all."""
    row = [(made.version, made.snapshot, made.high_water)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(_manifest_folder(folder))


def vacuum(spark: SparkSession, folder: str) -> list[str]:
    """Delete what no reader of the current version or of the one before needs: batches folded by then, and other snapshots."""
    known = versions(spark, folder)
    kept = {v.snapshot.rsplit("=", 1)[1] for v in known[:2] if v.snapshot}
    previous = known[1].high_water if len(known) > 1 else -1
    old = [place for n, place in storage.partitions(spark, folder, BATCH).items() if int(n) <= previous]
    old += [place for v, place in storage.partitions(spark, f"{folder.rstrip('/')}-snapshots", "v", finished=True).items() if v not in kept]
    for place in old:
        storage.remove(spark, place)
    return old


def read_current(base: DataFrame, schema: str, folder: str) -> DataFrame:
    """The current inventory: ``base`` with the snapshot and the later batches merged in."""
    spark = base.sparkSession
    return apply_delta(base, _log(spark, folder, schema, versions(spark, folder)[0]))
