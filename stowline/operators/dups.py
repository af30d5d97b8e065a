"""Duplicates, search, consolidation and replica health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.operators.identity import BLOB_KEY
from stowline.scale import ROWS_PER_BUCKET, lookup_join, order_buckets, rank_in, skew_join
from stowline.session import cut_lineage


def confirmed_dups(contents: DataFrame, key: Sequence[str] = ("library_id", "content_id")) -> DataFrame:
    """Groups of equal content with more than one replica, and the bytes the extra copies take; no id, no group.

    Fixed-width aggregates only: a group of any size is one row, reduced before the shuffle.
    """
    return contents.dropna(subset=list(key)).groupBy(*key).agg(
        F.count(F.lit(1)).alias("replicas"), F.count_distinct("location_id").alias("locations"),
        F.min("file_id").alias("first_file_id"), F.max("size").alias("size"),
    ).filter(F.col("replicas") > 1).withColumn("extra_bytes", F.col("size") * (F.col("replicas") - 1))


def dup_members(contents: DataFrame, key: Sequence[str] = ("library_id", "content_id")) -> DataFrame:
    """The files of the confirmed groups, one row each, instead of a list per group.

    The contents are stored first: they are read several times, but the bodies behind their ids must be hashed once only.
    """
    contents = cut_lineage(contents)
    groups = contents.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("replicas")).filter(F.col("replicas") > 1)
    return skew_join(contents, groups, key, "inner")


def suspect_dups(files: DataFrame) -> DataFrame:
    """Byte files of equal size and case-folded name: a hint only, blobs are never merged by it."""
    named = files.filter((F.col("kind") == "byte") & F.col("size").isNotNull())
    return named.groupBy("library_id", "size", F.lower("name").alias("folded_name")).agg(
        F.count(F.lit(1)).alias("files"), F.min("file_id").alias("first_file_id"), F.max("file_id").alias("last_file_id"),
    ).filter(F.col("files") > 1)


def suspect_members(files: DataFrame) -> DataFrame:
    """The files of the suspect groups, one row each."""
    keyed = files.filter((F.col("kind") == "byte") & F.col("size").isNotNull()).withColumn("folded_name", F.lower("name"))
    groups = suspect_dups(files).select("library_id", "size", "folded_name", "files")
    return skew_join(keyed, groups, ["library_id", "size", "folded_name"], "inner")


def cross_location_dups(contents: DataFrame, key: Sequence[str] = ("library_id", "content_id")) -> DataFrame:
    return confirmed_dups(contents, key).filter(F.col("locations") > 1)


def usable_verified() -> Column:
    """A replica that counts for last copy: verified, readable and on a mounted location."""
    return (F.col("state") == "verified") & (F.col("hydration") != "placeholder") & F.col("is_online")


def extra_local(replicas: DataFrame, keep_first: Column | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Surplus local replicas of a verified blob that may go while another verified one stays.

    ``replicas`` carries state, hydration, location_kind, is_online and pinned. Candidates are numbered
    per blob (``keep_first`` ascending, then file id) and number k goes only while
    ``verified - k >= 1``: two candidates never justify each other's removal. One local copy stays.
    """
    rank = F.lit(0) if keep_first is None else keep_first
    good = replicas.filter(usable_verified())
    counts = good.groupBy(*BLOB_KEY).agg(
        F.count(F.lit(1)).alias("verified"), F.count_if(F.col("location_kind") == "volume").alias("local_verified"))
    counts = counts.filter((F.col("verified") > 1) & (F.col("local_verified") > 1))
    local = good.filter((F.col("location_kind") == "volume") & ~F.coalesce(F.col("pinned"), F.lit(False)))
    candidates = skew_join(local, counts, BLOB_KEY, "inner", hot_rows=rows_per_bucket).withColumn("_first", rank)
    bucketed, buckets = order_buckets(candidates, BLOB_KEY, "file_id", descending=True, rows_per_bucket=rows_per_bucket)
    if buckets:
        bucketed = bucketed.withColumn("_b0", -F.col("_first"))
        buckets = ["_b0", *buckets]
    ranked = rank_in(bucketed, BLOB_KEY, [F.col("_first").desc(), F.col("file_id").desc()], "evict_no", buckets)
    goes = (F.col("verified") - F.col("evict_no") >= 1) & (F.col("local_verified") - F.col("evict_no") >= 1)
    return ranked.filter(goes).select("library_id", "blob_id", "file_id", "location_id", "size", "verified", "evict_no")


def consolidate(replicas: DataFrame, dest: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One verified copy at the library's ``dest``: what to place, what local copy may then go, what cloud copy stays.

    ``dest`` holds (library_id, dest). A blob already verified at its dest needs no placement and its
    other local copies are evict candidates; while the placement is pending they are kept back by one.
    """
    with_dest = lookup_join(replicas, dest, ["library_id"], "inner")
    at_dest = with_dest.filter((F.col("location_id") == F.col("dest")) & usable_verified()).select(*BLOB_KEY).distinct()
    sized = with_dest.filter(F.col("size").isNotNull() & (F.col("hydration") != "placeholder") & F.col("is_online"))
    blobs = sized.groupBy(*BLOB_KEY, "dest").agg(F.max("size").alias("size"))
    place = blobs.join(at_dest, BLOB_KEY, "left_anti").select(
        "library_id", "blob_id", F.lit(None).cast("long").alias("file_id"), F.col("dest").alias("location_id"),
        "size", F.lit("place").alias("action"))
    good = with_dest.filter(usable_verified() & (F.col("location_id") != F.col("dest")))
    present = skew_join(good, at_dest, BLOB_KEY, "left_semi", hot_rows=rows_per_bucket)
    action = F.when(F.col("location_kind") == "volume", "evict_candidate").otherwise("report_cloud")
    pinned = F.coalesce(F.col("pinned"), F.lit(False)) & (F.col("location_kind") == "volume")
    spare = present.filter(~pinned).select("library_id", "blob_id", "file_id", "location_id", "size", action.alias("action"))
    return place.unionByName(spare)


def search(files: DataFrame, needle: str, collections: DataFrame | None = None) -> DataFrame:
    """Files whose path, MIME type or collection holds the literal text, in any case."""
    text = needle.lower()
    source = files
    if collections is not None:
        hits = collections.filter(F.lower("collection").contains(text)).select("library_id", "file_id").distinct()
        source = files.join(hits.withColumn("_in_collection", F.lit(True)), ["library_id", "file_id"], "left")
    test = F.coalesce(F.lower("path").contains(text), F.lit(False))
    if "mime" in files.columns:
        test = test | F.coalesce(F.lower("mime").contains(text), F.lit(False))
    if collections is not None:
        test = test | F.coalesce(F.col("_in_collection"), F.lit(False))
    return source.filter(test).select(*files.columns)


def list_collection(files: DataFrame, cache: DataFrame, replicas: DataFrame, name: str) -> DataFrame:
    """Files of one collection with size, path, hydration, content id and the number of providers of the blob."""
    chosen = cache.filter(F.col("collection") == name).select("library_id", "file_id")
    rows = files.join(chosen, ["library_id", "file_id"], "left_semi").join(
        replicas.select("library_id", "file_id", "blob_id", "content_id"), ["library_id", "file_id"])
    holders = replicas.groupBy(*BLOB_KEY).agg(F.count_distinct("provider_id").alias("providers"))
    return skew_join(rows, holders, BLOB_KEY, "inner").select(
        "library_id", "file_id", "path", "size", "hydration", "content_id", "providers")


def replica_health(replicas: DataFrame) -> DataFrame:
    """Per blob: verified, suspect, placeholder and offline counts; at risk when no usable verified copy is left."""
    usable = usable_verified()
    return replicas.groupBy(*BLOB_KEY).agg(
        F.count_if(usable).alias("verified"),
        F.count_if((F.col("state") == "suspect") & (F.col("hydration") != "placeholder")).alias("suspect"),
        F.count_if(F.col("hydration") == "placeholder").alias("placeholder"),
        F.count_if(~F.col("is_online")).alias("offline"),
        (F.count_if(usable) == 0).alias("at_risk"),
    )
