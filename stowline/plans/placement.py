"""From goals to unordered needs and evict candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.operators.capacity import with_usable
from stowline.operators.dups import usable_verified
from stowline.operators.identity import BLOB_KEY
from stowline.scale import lookup_join, skew_join
from stowline.session import cut_lineage


def readable() -> Column:
    """A replica that may be copied from: whole bytes, no placeholder, mounted."""
    return (F.col("hydration") != "placeholder") & F.col("state").isin("verified", "suspect") & F.col("is_online")


def need_place(goals: DataFrame, replicas: DataFrame) -> DataFrame:
    """Goals that no whole object at the dest meets.

    A suspect object already there suppresses the placement, since a copy onto itself verifies nothing;
    it still never counts for last copy. Blobs of unknown size never enter a plan.
    """
    present = replicas.filter((F.col("hydration") != "placeholder") & F.col("state").isin("verified", "suspect")).select(
        *BLOB_KEY, F.col("location_id").alias("dest")).distinct()
    return goals.filter(F.col("size").isNotNull()).join(present, [*BLOB_KEY, "dest"], "left_anti")


def choose_source(needs: DataFrame, replicas: DataFrame) -> DataFrame:
    """Best source per blob: a verified local full copy, a suspect one, then any cloud copy; ties by location and file.

    One aggregate per blob and one join; needs without a source keep NULLs and ``no_source``.
    """
    local = F.col("location_kind") == "volume"
    rank = F.when(local, 0).otherwise(2) + F.when(F.col("state") == "verified", 0).otherwise(1)
    usable = replicas.filter(readable() & ((F.col("hydration") == "local_full") | ~local))
    best = usable.groupBy(*BLOB_KEY).agg(
        F.min(F.struct(rank.alias("r"), "location_id", "file_id", "location_kind", "path")).alias("s"))
    best = best.select(
        *BLOB_KEY, F.col("s.location_id").alias("src"), F.col("s.location_kind").alias("src_kind"),
        F.col("s.file_id").alias("src_file_id"), F.col("s.path").alias("path"))
    return needs.join(best, BLOB_KEY, "left").withColumn("no_source", F.col("src").isNull())


def can_evict(goals: DataFrame, replicas: DataFrame, needs: DataFrame, placement: DataFrame) -> DataFrame:
    """Local copies outside the goal, not pinned, whose blob has another verified copy or a pending cloud placement.

    A candidate only; the sequencing decides when, and never drops the last verified copy.
    """
    good = replicas.filter(usable_verified())
    verified = good.groupBy(*BLOB_KEY).agg(F.count(F.lit(1)).alias("verified"))
    local = good.filter((F.col("location_kind") == "volume") & (F.col("hydration") == "local_full")).select(
        *BLOB_KEY, "file_id", "location_id", "size").filter(F.col("size").isNotNull())
    rules = placement.filter(~F.col("pin_local")).select(*BLOB_KEY, F.col("min_replicas").cast("long").alias("min_replicas"))
    n_goals = goals.groupBy(*BLOB_KEY).agg(F.count_distinct("dest").alias("n_goals"))
    # Read twice, for the hot keys and for the join, so stored first.
    outside = cut_lineage(local.join(goals.select(*BLOB_KEY, F.col("dest").alias("location_id")), [*BLOB_KEY, "location_id"], "left_anti"))
    to_cloud = needs.filter((F.col("dest_kind") == "cloud") & ~F.col("no_source")).select(*BLOB_KEY).distinct().withColumn(
        "_cloud", F.lit(True))
    per_blob = rules.join(n_goals, BLOB_KEY).join(verified, BLOB_KEY).join(to_cloud, BLOB_KEY, "left")
    joined = skew_join(outside, per_blob, BLOB_KEY, "inner")
    return joined.filter((F.col("verified") > 1) | F.col("_cloud")).drop("verified", "_cloud")


def classify_ops(needs: DataFrame, evicts: DataFrame) -> DataFrame:
    """Class of each sourced need and what it does to free space: bytes at the dest and at the staging volume."""
    blobs = evicts.select(*BLOB_KEY).distinct().withColumn("_evict", F.lit(True))
    to_cloud = F.col("dest_kind") == "cloud"
    from_local = F.col("src_kind") == "volume"
    kind = (
        F.when(to_cloud & from_local & F.col("_evict"), "upload_evict").when(to_cloud & from_local, "upload_keep")
        .when(to_cloud, "shuttle").otherwise("download")
    )
    marked = needs.filter(~F.col("no_source")).join(blobs, BLOB_KEY, "left").withColumn("op_class", kind)
    volume_delta = F.when(F.col("op_class") == "download", -F.col("size")).otherwise(F.lit(0).cast("long"))
    trough = F.when(F.col("op_class").isin("download", "shuttle"), -F.col("size")).otherwise(F.lit(0).cast("long"))
    return marked.withColumn("during_delta", trough).withColumn("after_delta", volume_delta).drop("_evict")


def too_large(needs: DataFrame, evicts: DataFrame, locations: DataFrame, reserve: int) -> DataFrame:
    """Local needs larger than all that could ever be free at their dest: usable plus every evictable byte."""
    freed = evicts.groupBy("library_id", F.col("location_id").alias("dest")).agg(F.sum("size").alias("evictable"))
    room = with_usable(locations.filter(F.col("kind") == "volume"), reserve).select(
        "library_id", F.col("location_id").alias("dest"), "usable").join(freed, ["library_id", "dest"], "left")
    room = room.withColumn("room", F.col("usable") + F.coalesce("evictable", F.lit(0)))
    local = needs.filter(F.col("dest_kind") == "volume")
    return lookup_join(local, room.select("library_id", "dest", "room"), ["library_id", "dest"], "inner").filter(
        F.col("size") > F.col("room"))
