"""Corpus pipeline: each stage is one operator of ``stowline.llm``, written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowline.llm import stages
from stowline.session import new_folder

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_lines),
    ("near_dedup", stages.drop_near_duplicates),
    ("decontamination", stages.drop_leaks),
    ("encode", stages.encode),
]

#: A trained classifier, MinHash and BPE have no SQL form; tests/llm/test_pipeline.py holds each stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        folder = new_folder(spark, f"stage-{name}")
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
    return docs
