"""Local file listings and bodies."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.functions.content import DIGEST_ALGORITHMS, ID_ALGORITHM, UnsupportedDigest
from stowline.session import cut_lineage

READ_CHUNK_BYTES = 1 << 20
LIST_BATCH_ROWS = 10_000


def list_files(spark: SparkSession, roots: Sequence[str], glob: str | None = None) -> DataFrame:
    """Path, name, size and time of the files under mounted ``roots``; bodies are never read.

    Folders are read by executors, one level of the tree per pass, and every level is stored before the
    next. The built-in file source would keep the whole listing on the driver, and it skips empty files.
    Links are not followed.
    """
    schema = "path STRING, name STRING, is_dir BOOLEAN, size BIGINT, mtime_us BIGINT"
    frontier = spark.createDataFrame([(r.removeprefix("file:"),) for r in roots], "path STRING")
    found = None
    while True:
        level = cut_lineage(frontier.repartition("path").mapInPandas(_read_folders, schema))
        plain = level.filter(~F.col("is_dir")).select("path", "name", "size", F.timestamp_micros("mtime_us").alias("mtime_utc"))
        found = plain if found is None else found.unionByName(plain)
        frontier = level.filter("is_dir").select("path")
        if frontier.isEmpty():
            break
    return found.filter(F.col("name").like(glob.replace("%", "\\%").replace("_", "\\_").replace("*", "%"))) if glob else found


def _read_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of each folder, in bounded batches, so that one huge folder is never held whole."""
    columns = ["path", "name", "is_dir", "size", "mtime_us"]
    for batch in batches:
        for folder in batch["path"]:
            rows = []
            with os.scandir(folder) as entries:
                for entry in entries:
                    if entry.is_symlink():
                        continue
                    stat = entry.stat(follow_symlinks=False)
                    rows.append((entry.path, entry.name, entry.is_dir(follow_symlinks=False), stat.st_size, stat.st_mtime_ns // 1000))
                    if len(rows) == LIST_BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def digest_large_files(paths: DataFrame, algos: Sequence[str] = ("md5",), partitions: int | None = None) -> DataFrame:
    """Content id and native digests of bodies too large for one cell, streamed in 1 MiB chunks on executors.

    ``paths`` holds a ``path`` column of files every executor can open. Rows are spread evenly first,
    because a listing usually arrives in few partitions and hashing is the whole cost.
    """
    for algo in algos:
        if algo not in DIGEST_ALGORITHMS:
            raise UnsupportedDigest(f"{algo}: known digests are {', '.join(DIGEST_ALGORITHMS)}")
    wanted = list(algos)

    def hash_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                running = {a: hashlib.new(a) for a in {ID_ALGORITHM, *wanted}}
                size = 0
                with open(path.removeprefix("file:"), "rb") as body:
                    while chunk := body.read(READ_CHUNK_BYTES):
                        size += len(chunk)
                        for h in running.values():
                            h.update(chunk)
                rows.append([path, size, f"{ID_ALGORITHM}:{running[ID_ALGORITHM].hexdigest()}",
                             *[running[a].hexdigest() for a in wanted]])
            yield pd.DataFrame(rows, columns=["path", "size", "content_id", *wanted])

    schema = ", ".join(["path STRING", "size BIGINT", "content_id STRING", *[f"{a} STRING" for a in wanted]])
    todo = paths.select("path")
    todo = todo.repartition(partitions) if partitions else todo.repartition("path")
    return todo.mapInPandas(hash_batch, schema)
