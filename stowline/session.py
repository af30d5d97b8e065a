"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", app: str = "stowline", **conf: str) -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a scratch folder in local mode only."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is not None:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="stowline-")
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name of the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, split: str | None = None) -> DataFrame:
    """Store a loop state as a table of the shared folder, so that a lost executor costs a re-read, not a replay.

    A Parquet table rather than an RDD checkpoint: later steps read only the columns they use, and its
    known size lets Catalyst pick the join strategy. With ``split`` the table has a folder for each value of that column, so
    that readers of one value skip the others.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "state")
    (df.write.partitionBy(split) if split else df.write).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
