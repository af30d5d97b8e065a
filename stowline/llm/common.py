"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.session import cut_lineage

WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; whatever else the table holds can't clash."""
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def pieces(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that memory follows the longest text, not the batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def checked_join(big: DataFrame, keys: DataFrame, on: Sequence[str], how: str = "left", most: int = 200_000) -> DataFrame:
    """Join to a narrow table of keys: by broadcast if it was counted and holds at most ``most`` rows, else by shuffle.

    In the shuffled form adaptive execution splits the hot keys of ``big``, as each meets one row at most.
    """
    few = keys.limit(most + 1).count() <= most
    return big.join(F.broadcast(keys) if few else keys, list(on), how)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node named by a link (a, b): root is the smallest node reachable.

    Large-star and small-star contraction in turn, each one aggregate and one join; every pass is written
    to the shared folder. Nothing is collected but one count and one checksum a pass.
    """
    edges = cut_lineage(
        links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        after = cut_lineage(small)
        if _print(after) == _print(edges):
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after
    raise RuntimeError(f"components did not settle in {rounds} passes")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


