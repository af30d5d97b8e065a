"""The operators as pipeline stages: each takes (spark, docs, sf_dir) and returns a frame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.llm import decontaminate, line_templates, minhash_forest, toxicity
from stowline.llm.bpe import bpe
from stowline.llm.common import table
from stowline.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, trained on the labels, does not reject.

    Null, empty and blank texts stay; repeated rows share their fate; columns of any name are carried as they are.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines of templates that recur across them; every document stays.

    A null text stays null; ``n_chars`` follows the text; columns of any name are carried as they are.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    cut = line_templates.drop_recurring_lines(docs.select(rest, "text"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return cut.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id."""
    found = minhash_forest.near_duplicates(docs, size=5, percent=80)
    gone = cut_lineage(found.where("NOT kept").select("doc_id").distinct())
    return minhash_forest.without(docs, gone)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.decontaminate(docs, found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    return bpe(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
